"""Staging rules: keep-first and keep-last by key, replacement of partial rows, and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str], last: bool = False) -> DataFrame:
    """One row a key: the first (or last) by ``order``; null keys are a group like any other."""
    order = [F.desc(c) if last and isinstance(c, str) else c for c in order]
    rank = free_name(df, "rank")
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) == 1).drop(rank)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def replace_rows(base: DataFrame, better: DataFrame, key: str) -> DataFrame:
    """All rows of ``better``, and those of ``base`` whose key it lacks."""
    return base.join(better.select(key).distinct(), key, "left_anti").unionByName(better, allowMissingColumns=True)


def shape_reason(participants: DataFrame, fight: str = "fight_id") -> DataFrame:
    """Fights without exactly two sides, one red and one blue."""
    shape = participants.groupBy(fight).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("corner")).alias("corners"))
    good = (F.col("n") == 2) & (F.col("corners") == F.array(F.lit("blue"), F.lit("red")))
    return shape.where(~good).select(fight, F.lit("invalid_participant_shape").alias("reason"))


def domain_reason(promotion: Column, text: Column) -> Column:
    """Bouts of promotions named like ONE under other rules than mixed martial arts."""
    other = text.rlike("(?i)kickboxing|muay thai|(submission )?grappling")
    return F.when(F.lower(promotion).contains("one") & other, F.lit("ambiguous_or_non_mma_one_bout"))


def split_quarantine(rows: DataFrame, reasons: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Clean rows, and the rejected ones with their reason."""
    return rows.join(reasons.select(key), key, "left_anti"), rows.join(reasons, key)


def repair_candidates(seen: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Ids seen in events that have no profile yet."""
    return seen.select(key).where(F.col(key).isNotNull()).distinct().join(cached.select(key), key, "left_anti")


def search_buckets(names: DataFrame, candidates: DataFrame, key: str = "name_key") -> DataFrame:
    """How many searched names have one, several or no candidates."""
    counts = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    found = names.select(key).distinct().join(counts, key, "left")
    bucket = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    return found.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("names"))


def past(rows: DataFrame, today, date: str = "event_date") -> DataFrame:
    """Rows that aren't dated after ``today``; of rows without a date nothing says that they are still to come, so they stay."""
    return rows.where(F.coalesce(F.col(date) <= F.lit(today).cast("date"), F.lit(True)))


def merged(rows: DataFrame, keys: list[str], rank: Column, columns: list[str] | None = None) -> DataFrame:
    """Of the rows of each key the one with the largest ``rank``, by one aggregation that keeps one row a key and task.

    Last wins with the order itself as rank, first wins with the smallest of the negated order; a struct ranks by kind, then order.
    ``columns`` are those that the result has besides the keys.
    """
    columns = columns or [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), rank).alias("best"))
    return best.select(*keys, *[F.col("best")[c].alias(c) for c in columns])
