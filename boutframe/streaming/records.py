"""Running records of fighters over a stream of bout sides: event-time windows with a watermark for late bouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_records(sides: DataFrame, lateness: str = "7 days", time: str = "event_time") -> DataFrame:
    """``fighter_id, day, fights, wins`` of each day, closed once the watermark has passed it.

    ``sides`` has fighter_id, winner_flag and a timestamp. Sums of strictly earlier days over the result are the history
    features; a day is emitted whole, so bouts of one day never see each other.
    """
    days = sides.withWatermark(time, lateness).groupBy("fighter_id", F.window(time, "1 day"))
    counted = days.agg(F.count(F.lit(1)).alias("fights"), F.sum(F.coalesce(F.col("winner_flag"), F.lit(False)).cast("long")).alias("wins"))
    return counted.select("fighter_id", F.to_date("window.start").alias("day"), "fights", "wins")
