"""boutframe: point-in-time analytics over two-sided contests, expressed as Spark plans."""
