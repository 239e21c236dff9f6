"""The driver's order tables seen as two-sided bouts.

A bout is an order of exactly two line items of different suppliers; its date is the order's, its sides are the suppliers.
The larger quantity wins, equal ones draw. One shuffle of the line items by order gives both sides: what a side needs of
the other one comes from the same window. Only items of orders with two are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a side of every bout."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    every = Window.partitionBy("l_orderkey")
    side = lambda n, c: F.max(F.when(F.col("rn") == n, F.col(c))).over(every)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
    lines = lines.withColumns({"n": F.count(F.lit(1)).over(every), "low": F.min("l_suppkey").over(every), "high": F.max("l_suppkey").over(every)}).where("n = 2 and low <> high")
    lines = lines.withColumns({"rn": F.row_number().over(order), "landed": F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))})
    lines = lines.withColumns({f"{c}{n}": side(n, c) for c in ("l_suppkey", "l_quantity", "landed", "l_linenumber", "l_returnflag") for n in (1, 2)})
    own = F.col("rn") == 1
    other = lambda c: F.when(own, F.col(f"{c}2")).otherwise(F.col(f"{c}1"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("event_date"), F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("promotion"))
    method = F.when(F.col("l_returnflag1") == "A", "KO/TKO").when(F.col("l_returnflag1") == "N", "Submission").otherwise("Decision")
    return lines.join(orders, "l_orderkey").select(
        F.col("l_orderkey").alias("fight_id"), "event_date", "source", "promotion", F.when(own, "blue").otherwise("red").alias("corner"),
        F.col("l_suppkey").alias("fighter_id"), other("l_suppkey").alias("opponent_id"), (F.col("l_quantity") > other("l_quantity")).alias("winner_flag"),
        F.when(F.col("l_quantity") > other("l_quantity"), "W").when(F.col("l_quantity") < other("l_quantity"), "L").otherwise("D").alias("outcome"),
        method.alias("method"), ((F.col("l_linenumber1") - 1) * 300 + F.col("l_quantity1") * 5).alias("fight_sec"),
        F.col("landed").alias("sig_str_landed"), other("landed").alias("sig_str_absorbed"), F.col("l_linenumber").cast("double").alias("td_landed"),
        (F.col("l_linenumber") + F.col("l_partkey") % 3).cast("double").alias("td_attempted"), F.when(F.col("l_partkey") % 7 > 0, (F.col("l_partkey") % 4).cast("double")).alias("sub_att"),
        F.when(F.col("l_partkey") % 5 > 0, (F.col("l_partkey") % 300).cast("double")).alias("ctrl_sec"), F.date_add(F.lit("1950-01-01").cast("date"), (F.col("l_suppkey") % 9000).cast("int")).alias("dob"),
        (F.lit(60) + F.col("l_suppkey") % 20).cast("int").alias("height_in"), F.when(F.col("l_suppkey") % 6 > 0, (F.lit(62) + F.col("l_suppkey") % 18).cast("int")).alias("reach_in"),
    )


#: The same rows as DuckDB common table expressions; the last one is ``b``.
BOUTS = """WITH l AS (SELECT *, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS landed,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS rn,
    count(*) OVER (PARTITION BY l_orderkey) AS n, min(l_suppkey) OVER (PARTITION BY l_orderkey) AS low, max(l_suppkey) OVER (PARTITION BY l_orderkey) AS high FROM lineitem),
b AS (SELECT x.l_orderkey AS fight_id, o.o_orderdate::DATE AS event_date, o.o_orderstatus AS source, o.o_orderpriority AS promotion,
    CASE WHEN x.rn = 1 THEN 'blue' ELSE 'red' END AS corner, x.l_suppkey AS fighter_id, y.l_suppkey AS opponent_id, x.l_quantity > y.l_quantity AS winner_flag,
    CASE WHEN x.l_quantity > y.l_quantity THEN 'W' WHEN x.l_quantity < y.l_quantity THEN 'L' ELSE 'D' END AS outcome,
    CASE f.l_returnflag WHEN 'A' THEN 'KO/TKO' WHEN 'N' THEN 'Submission' ELSE 'Decision' END AS method,
    (f.l_linenumber - 1) * 300 + f.l_quantity * 5 AS fight_sec, x.landed AS sig_str_landed, y.landed AS sig_str_absorbed, x.l_linenumber::DOUBLE AS td_landed,
    (x.l_linenumber + x.l_partkey % 3)::DOUBLE AS td_attempted, CASE WHEN x.l_partkey % 7 > 0 THEN (x.l_partkey % 4)::DOUBLE END AS sub_att, CASE WHEN x.l_partkey % 5 > 0 THEN (x.l_partkey % 300)::DOUBLE END AS ctrl_sec,
    DATE '1950-01-01' + (x.l_suppkey % 9000)::INT AS dob, (60 + x.l_suppkey % 20)::INT AS height_in, CASE WHEN x.l_suppkey % 6 > 0 THEN (62 + x.l_suppkey % 18)::INT END AS reach_in
    FROM l x JOIN l y ON x.l_orderkey = y.l_orderkey AND x.rn <> y.rn JOIN l f ON f.l_orderkey = x.l_orderkey AND f.rn = 1 JOIN orders o ON o.o_orderkey = x.l_orderkey
    WHERE x.n = 2 AND x.low <> x.high)"""
#: The frame of all rows of the same fighter on strictly earlier dates.
EARLIER = "(PARTITION BY fighter_id ORDER BY event_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"
