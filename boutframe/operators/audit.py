"""Data-quality audits: declarative checks, each a one-row frame, collected in one job; per-table metrics share one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutframe.schemas import CHECK, conform


def check(metric: DataFrame, table: str, name: str, threshold: str = "0", details: str = "", bad: str = "fail") -> DataFrame:
    """A check from a frame with one number: ``bad`` unless it is 0."""
    value = F.col(metric.columns[0]).cast("double")
    status = F.when(value == 0, "pass").otherwise(bad)
    return metric.select(status.alias("status"), F.lit(table).alias("table_name"), F.lit(name).alias("check_name"), value.alias("metric_value"), F.lit(threshold).alias("threshold"), F.lit(details).alias("details"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("duplicate_keys"))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """How many child rows have a key that the parent lacks (nulls too)."""
    keys = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.join(keys, key, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


def bad_shapes(participants: DataFrame, fight: str = "fight_id") -> DataFrame:
    """How many fights don't have two sides."""
    return participants.groupBy(fight).agg(F.count(F.lit(1)).alias("n")).where("n <> 2").agg(F.count(F.lit(1)).alias("bad"))


def schema_mismatches(df: DataFrame, schema: T.StructType) -> list[str]:
    """Columns that are missing or of another type."""
    have = {f.name: f.dataType for f in df.schema}
    return [f.name for f in schema if have.get(f.name) != f.dataType]


def missingness(df: DataFrame, table: str, columns: list[str], groups: list[str] = (), fail: tuple[str, ...] = ()) -> DataFrame:
    """Missing values of each column by group, from one aggregation: pass at 0, fail for the columns named, else warn."""
    keys = [F.col(g) for g in groups] or [F.lit("all").alias("source")]
    nulls = [F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns]
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *nulls)
    names = list(groups) or ["source"]
    long = wide.unpivot([*names, "rows"], columns, "column_name", "missing")
    pct = F.round(F.lit(100.0).cast("double") * F.col("missing") / F.col("rows"), 3)
    status = F.when(F.col("missing") == 0, "pass").when(F.col("column_name").isin(*fail), "fail").otherwise("warn")
    return long.select(F.lit(table).alias("table_name"), *names, "column_name", "rows", "missing", pct.alias("missing_pct"), status.alias("status"))


def coverage(events: DataFrame, fights: DataFrame, participants: DataFrame, groups: list[str]) -> DataFrame:
    """Events, fights and fighters by group; counts are taken before joining, so that nothing fans out."""
    by = lambda df, *agg: df.groupBy(*groups).agg(*agg)
    out = by(events, F.count_distinct("event_id").alias("events"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))
    out = out.join(by(fights, F.count_distinct("fight_id").alias("fights")), groups, "left").join(by(participants, F.count_distinct("fighter_id").alias("fighters")), groups, "left")
    return out.withColumn("fights_per_event", F.round(F.col("fights").cast("double") / F.col("events"), 3))


def recounted(rows: DataFrame, participants: DataFrame | None = None) -> DataFrame:
    """Rows with ``expected_prior_fights`` and ``same_day_history_count``, from counts by day that meet the rows in a join.

    The recount doesn't share the features' window: bouts are counted by fighter and day first, running sums go over days.
    """
    days = (rows if participants is None else participants).groupBy("fighter_id", "event_date").agg(F.count(F.lit(1)).alias("that_day"))
    past = Window.partitionBy("fighter_id").orderBy("event_date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("expected_prior_fights", F.coalesce(F.sum("that_day").over(past), F.lit(0)))
    joined = rows.join(days, ["fighter_id", "event_date"], "left")
    return joined.withColumns({"expected_prior_fights": F.coalesce("expected_prior_fights", F.lit(0)), "same_day_history_count": F.greatest(F.coalesce("that_day", F.lit(0)) - 1, F.lit(0))}).drop("that_day")


def leakage(rows: DataFrame) -> DataFrame:
    """How many rows' prior_fights differ from a recount over strictly earlier dates."""
    return recounted(rows).agg(F.count_if(F.col("prior_fights") != F.col("expected_prior_fights")).alias("leaks"))


def same_day(rows: DataFrame) -> DataFrame:
    """How many fighter-days have several bouts."""
    return rows.groupBy("fighter_id", "event_date").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("same_day"))


def flags(**tests: Column) -> Column:
    """The names of the tests that hold, joined by semicolons."""
    return F.array_join(F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull()), ";")


def tally(checks: DataFrame) -> DataFrame:
    return checks.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warn", "fail")])


def standard(checks: DataFrame) -> DataFrame:
    return conform(checks, CHECK)


def pit(rows: DataFrame, participants: DataFrame, matchups: DataFrame) -> DataFrame:
    """Checks of the as-of features: as many rows as sides, recounted priors, same-day history left out, one matchup a bout."""
    counts = recounted(rows, participants).agg(
        F.count_if(F.col("prior_fights") != F.col("expected_prior_fights")).alias("leaks"),
        F.count_if((F.col("same_day_history_count") > 0) & (F.col("prior_fights") != F.col("expected_prior_fights"))).alias("same_day"),
    )
    parity = rows.select(F.lit(1).alias("v")).unionAll(participants.select(F.lit(-1))).agg(F.abs(F.coalesce(F.sum("v"), F.lit(0))).alias("v"))
    return union_all([
        check(parity, "pit_fighter_features", "pit_rows_match_participants"), check(counts.select("leaks"), "pit_fighter_features", "pit_prior_fights_no_leakage"),
        check(counts.select("same_day"), "pit_fighter_features", "pit_same_day_history_excluded"), check(duplicates(matchups, ["fight_id"]), "pit_matchup_features", "pit_matchup_unique_fight_id"),
    ])


def pit_view(rows: DataFrame, participants: DataFrame) -> DataFrame:
    """Every side with its recount and whether it differs."""
    named = recounted(rows, participants).withColumn("has_anomaly", F.col("prior_fights") != F.col("expected_prior_fights"))
    wanted = "fight_id event_id event_date fighter_id opponent_id source promotion full_name prior_fights expected_prior_fights same_day_history_count has_anomaly".split()
    return named.select(*[c for c in wanted if c in named.columns])


def identity(links: DataFrame) -> DataFrame:
    """Fighters by source and link method: with and without a birth date, a sample name, and with a note."""
    noted = F.coalesce(F.col("override_note"), F.lit("")) != ""
    return links.groupBy("source", "link_method").agg(
        F.count(F.lit(1)).alias("fighters"), F.count("dob").alias("with_dob"), F.count_if(F.col("dob").isNull()).alias("missing_dob"),
        F.min("full_name").alias("sample_name"), F.count_if(noted).alias("with_override_note"),
    )


def summary(tables: dict[str, DataFrame], events: DataFrame | None = None, links: DataFrame | None = None, overrides: DataFrame | None = None, review: DataFrame | None = None) -> DataFrame:
    """``section, metric_name, metric_value, details``: row counts and counts by source, promotion, link, decision and review status.

    What a run alone knows (the clock, file sizes) is left to the caller.
    """

    def rows(df: DataFrame, section: str, name: Column, details: Column, *keys: str, agg: tuple[Column, ...] = ()) -> DataFrame:
        counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *agg)
        return counted.select(F.lit(section).alias("section"), name.alias("metric_name"), F.col("n").cast("string").alias("metric_value"), details.alias("details"))

    two = lambda a, b: F.concat_ws("::", a, b)
    parts = [rows(df, "row_counts", F.lit(name), F.lit("")) for name, df in tables.items()]
    if events is not None:
        dates = F.concat(F.col("first").cast("string"), F.lit(" to "), F.col("last").cast("string"))
        parts.append(rows(events, "source_coverage", F.concat("source", F.lit("_events")), dates, "source", agg=(F.min("event_date").alias("first"), F.max("event_date").alias("last"))))
        parts.append(rows(events, "source_promotion", two("source", "promotion"), F.lit("event count"), "source", "promotion"))
    if links is not None:
        parts.append(rows(links, "identity_links", two("source", "link_method"), F.lit("fighters by link method"), "source", "link_method"))
    if overrides is not None:
        parts.append(rows(overrides, "manual_overrides", F.col("decision"), F.lit("manual identity overrides by decision"), "decision"))
    if review is not None:
        parts.append(rows(review, "identity_review", F.col("review_status"), F.lit("fighters by review status"), "review_status"))
    return union_all(parts)


def identity_checks(review: DataFrame, overrides: DataFrame) -> DataFrame:
    """A warning for fighters left unresolved or to be reviewed, and a failure for two approved targets of one fighter."""
    open_ = review.agg(F.count_if(F.col("review_status").isin("candidate_review", "unresolved")).alias("v"))
    several = overrides.where("decision = 'approved'").groupBy("source", "source_fighter_id").agg(F.count_distinct("target_source_fighter_id").alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("v"))
    return union_all([check(open_, "fighter_identity_links", "unresolved_identities", bad="warn"), check(several, "fighter_identity_manual_overrides", "single_approved_target")])


def not_null_checks(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """A failure for each required column with a null, from one aggregation."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).cast("double").alias(c) for c in columns])
    long = wide.unpivot([], columns, "column_name", "v")
    return long.select(F.when(F.col("v") == 0, "pass").otherwise("fail").alias("status"), F.lit(table).alias("table_name"), F.concat(F.lit("required_"), "column_name").alias("check_name"), F.col("v").alias("metric_value"), F.lit("0").alias("threshold"), F.lit("").alias("details"))


def schema_check(df: DataFrame, table: str, schema: T.StructType) -> DataFrame:
    """A failure that names the columns that are missing or of another type."""
    wrong = schema_mismatches(df, schema)
    one = df.sparkSession.range(1).select(F.lit(float(len(wrong))).alias("v"))
    return check(one, table, "schema", details=",".join(wrong))
