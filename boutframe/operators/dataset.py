"""Training sets without leaks: sides ordered by id, and splits that never cut a date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutframe.operators.staging import free_name

#: What may not be in a feature's name, because it tells the result, the side or where the row came from.
FORBIDDEN = ("red_", "blue_", "corner", "winner", "outcome", "source", "promotion")


def oriented(matchups: DataFrame, deltas: list[str]) -> DataFrame:
    """``matchups``: fight_id, event_date, red/blue fighter_id, winner_flag and outcome, and delta columns (red minus blue).

    Draws and no-contests go first, then rows whose two results agree; fighter a is the one with the smaller id, and the
    deltas take its side. ``+ 0.0`` makes negative zeros plain.
    """
    open_ = F.col("red_outcome").isin("D", "NC") | F.col("blue_outcome").isin("D", "NC")
    won = {s: F.coalesce(F.col(f"{s}_winner_flag"), F.lit(False)) for s in ("red", "blue")}
    red_first = F.col("red_fighter_id") <= F.col("blue_fighter_id")
    kept = matchups.where(~F.coalesce(open_, F.lit(False))).where(won["red"] != won["blue"])
    pick = lambda c, a, b: F.when(red_first, F.col(f"{a}_{c}")).otherwise(F.col(f"{b}_{c}"))
    return kept.select(
        "fight_id", "event_date", pick("fighter_id", "red", "blue").alias("fighter_a"), pick("fighter_id", "blue", "red").alias("fighter_b"),
        F.when(red_first, won["red"]).otherwise(won["blue"]).alias("target"),
        *[(F.col(d) * F.when(red_first, F.lit(1.0)).otherwise(F.lit(-1.0)) + 0.0).alias(d) for d in deltas],
    )


def metadata(matchups: DataFrame, dataset: DataFrame) -> DataFrame:
    """Rows in, kept and excluded, label balance and dates, as one row."""
    open_ = F.coalesce(F.col("red_outcome").isin("D", "NC") | F.col("blue_outcome").isin("D", "NC"), F.lit(False))
    given = matchups.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(open_).alias("excluded_draw_nc"))
    kept = dataset.agg(F.count(F.lit(1)).alias("rows_kept"), F.count_if("target").alias("a_wins"), F.count_if(~F.col("target")).alias("b_wins"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))
    both = given.withColumn("one", F.lit(1)).join(kept.withColumn("one", F.lit(1)), "one").drop("one")
    return both.withColumn("excluded_invalid", F.col("rows_in") - F.col("excluded_draw_nc") - F.col("rows_kept"))


def ranked_dates(df: DataFrame) -> DataFrame:
    """Distinct dates with their rank from 0 (``ordinal``) and how many there are (``dates``). Days: a few ten thousand at most."""
    dates = df.groupBy("event_date").agg(F.lit(1).alias("one"))
    return dates.select("event_date", (F.row_number().over(Window.orderBy("event_date")) - 1).alias("ordinal"), F.count(F.lit(1)).over(Window.partitionBy("one")).alias("dates"))


def temporal_split(df: DataFrame, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Add ``split``; every part has a date, and no date is in two. Fewer than three dates are an error when the rows are read."""
    n = F.when(F.col("dates") >= 3, F.col("dates")).otherwise(F.raise_error("at least three dates are needed").cast("long"))
    first = F.least(F.greatest(F.lit(1), F.floor(n * train)), n - 2)
    second = F.least(F.greatest(F.col("first") + 1, F.floor(n * (train + validation))), n - 1)
    part = F.when(F.col("ordinal") < F.col("first"), "train").when(F.col("ordinal") < second, "validation").otherwise("test")
    parts = ranked_dates(df).withColumn("first", first).select("event_date", part.alias("split"))
    return df.join(F.broadcast(parts), "event_date")  # dates: bounded


def walk_forward(df: DataFrame, folds: int = 8, initial: float = 0.5) -> DataFrame:
    """Add ``fold`` (from 0; null for dates that are only ever trained on). Fold k trains on all dates before its own."""
    start = F.greatest(F.lit(1), F.floor(F.col("dates") * initial))
    block = F.greatest(F.lit(1), F.ceil((F.col("dates") - start) / folds))
    fold = F.when(F.col("ordinal") >= start, F.floor((F.col("ordinal") - start) / block).cast("int"))
    return df.join(F.broadcast(ranked_dates(df).select("event_date", fold.alias("fold"))), "event_date")  # dates: bounded


def late_rows(train: DataFrame, share: float = 0.15, date: str = "event_date", then: str = "fight_id") -> DataFrame:
    """Mark the last share of training rows (by row, so it may cut a date) as the calibrator's validation.

    Rows are numbered within their date; what comes before a date is a running sum over the dates, of which there are few.
    """
    n, earlier, total = (free_name(train, x) for x in ("n", "earlier", "total"))
    dates = train.groupBy(date).agg(F.count(F.lit(1)).alias(n))
    every = Window.orderBy(date)  # over dates: bounded
    before = dates.select(date, (F.sum(n).over(every) - F.col(n)).alias(earlier), F.sum(n).over(Window.partitionBy(F.lit(0))).alias(total))
    place = F.col(earlier) + F.row_number().over(Window.partitionBy(date).orderBy(then))
    rows = train.join(F.broadcast(before), date)  # dates: bounded
    return rows.withColumn("is_validation", place > F.col(total) * (1 - share)).drop(earlier, total)


def forbidden_features(columns: list[str]) -> list[str]:
    return [c for c in columns if any(w in c.lower() for w in FORBIDDEN)]
