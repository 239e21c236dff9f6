"""All checks of a warehouse as one result, from a registry, with one pass over each table.

A check reads *facts*: every row of a table gives one fact for each check it matters to, namely the check's number, a key and up
to three counters. All facts of all tables meet in one aggregation by check and key, in which tasks have added up what they
have before anything is shuffled, and a second one by check decides. So a table is read once however many checks look at it,
orphans need no join, and a frequent key is one row a task. Checks of tables that aren't given are left out; those without facts pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutframe.operators.audit import schema_mismatches, standard, union_all
from boutframe.schemas import STAGING


@dataclass(frozen=True)
class Check:
    """``bad`` is the status unless the metric is 0; ``over`` lists whose rows give facts: ``(table, key columns, counters, condition)``."""

    table: str
    name: str
    over: tuple[tuple[str, tuple[str, ...], tuple[str, ...], str | None], ...]
    metric: str
    details: str
    threshold: str = "0"
    bad: str = "fail"
    by_key: bool = False


def unique(table: str, *keys: str, where: str | None = None, name: str | None = None, details: str | None = None) -> Check:
    """How many keys occur more than once."""
    return Check(table, name or f"unique_{'_'.join(keys)}", ((table, keys, ("1",), where),), "count_if(a > 1)", details or f"duplicate key groups for {', '.join(keys)}")


def foreign(table: str, name: str, key: str, parent: str) -> Check:
    """How many rows have a key, or none, that the parent lacks."""
    return Check(table, name, ((table, (key,), ("1",), None), (parent, (key,), ("0", "1"), f"{key} IS NOT NULL")), "sum(CASE WHEN b = 0 THEN a ELSE 0 END)", "orphan rows")


def shape(table: str) -> Check:
    """How many bouts don't have exactly one red and one blue side."""
    counters = ("1", "CASE WHEN corner = 'red' THEN 1 ELSE 0 END", "CASE WHEN corner = 'blue' THEN 1 ELSE 0 END")
    return Check(table, "fight_corner_shape", ((table, ("fight_id",), counters, None),), "count_if(a <> 2 OR b <> 1 OR c <> 1)", "fights must have exactly one red and one blue participant")


def required(table: str, column: str) -> Check:
    """How many values are missing, a row for each source and promotion."""
    return Check(table, f"required_{column}_not_null", ((table, ("source", "promotion"), (f"CASE WHEN {column} IS NULL THEN 1 ELSE 0 END",), None),), "sum(a)", "", by_key=True)


def counted(table: str, name: str, details: str, where: str | None = None, of: str | None = None) -> Check:
    """A warning that counts rows."""
    return Check(table, name, ((of or table, (), ("1",), where),), "sum(a)", details, "0 preferred", "warn")


#: The checks' tables, keys and columns.
REGISTRY = (
    unique("events", "event_id"), unique("source_events", "source", "source_event_id"), unique("fights", "fight_id"), unique("source_fights", "source", "source_fight_id"),
    unique("fight_participants", "fight_id", "fighter_id"), unique("source_fight_participants", "source", "source_fight_id", "source_fighter_id"), unique("fighters", "fighter_id"),
    unique("fighter_identity_manual_overrides", "source", "source_fighter_id", "target_source", "target_source_fighter_id"), unique("fighter_identity_links", "source", "source_fighter_id"),
    foreign("fights", "fight_event_fk", "event_id", "events"), foreign("fight_participants", "participant_fight_fk", "fight_id", "fights"), foreign("fight_participants", "participant_fighter_fk", "fighter_id", "fighters"),
    shape("fight_participants"), unique("pit_matchup_features", "fight_id", details="one matchup row per fight_id"),
    *(required("events", c) for c in ("event_id", "source", "source_event_id", "promotion", "name", "event_date")), *(required("fights", c) for c in ("fight_id", "event_id", "method", "round", "time")),
    *(required("fight_participants", c) for c in ("fighter_id", "opponent_id", "full_name")), *(required("fighters", c) for c in ("fighter_id", "full_name")),
    counted("fighter_identity_links", "unresolved_sherdog_identities", "fighters of the second source that no rule or decision links", "review_status = 'unresolved'", of="analysis_identity_review"),
    unique("fighter_identity_manual_overrides", "source_fighter_id", where="decision = 'approved'", name="single_approved_target_per_source_fighter", details="a fighter may have at most one approved manual target"),
    counted("parse_quarantine", "quarantined_rows", "Rows excluded from canonical analytical tables"),
)
SCHEMAS = ("parse_quarantine", "fighter_identity_manual_overrides")


def _key(columns: list[Column]) -> Column:
    """Values as one text that tells nulls from texts and keeps borders."""
    return F.to_json(F.array(*[c.cast("string") for c in columns])) if columns else F.lit("")


def facts(df: DataFrame, table: str, checks: list[tuple[int, Check]]) -> DataFrame | None:
    """``n, key, a, b, c``: what the rows of ``table`` say to the checks, from one pass."""
    every = []
    for n, check in checks:
        for of, keys, counters, where in check.over:
            if of != table:
                continue
            values = [F.expr(c).cast("long") for c in (*counters, "0", "0")[:3]]
            columns = [F.col(k) if k in df.columns else F.lit("all") for k in keys]
            fact = F.struct(F.lit(n).alias("n"), _key(columns).alias("key"), *[v.alias(name) for v, name in zip(values, "abc", strict=True)])
            every.append(F.when(F.expr(where), fact) if where else fact)
    return df.select(F.explode(F.array_compact(F.array(*every))).alias("fact")).select("fact.*") if every else None


def run(tables: dict[str, DataFrame], registry: tuple[Check, ...] = REGISTRY, pit: DataFrame | None = None) -> DataFrame:
    """``status, table_name, check_name, metric_value, threshold, details`` of every check whose tables are given; ``pit``: those of :func:`audit.pit`."""
    checks = [(n, c) for n, c in enumerate(registry) if c.table in tables and all(of in tables for of, *_ in c.over)]
    read = [f for name, df in tables.items() if (f := facts(df, name, checks)) is not None]
    spark, parts = next(iter(tables.values())).sparkSession, []
    if checks:
        by_key = union_all(read).groupBy("n", "key").agg(*[F.sum(c).alias(c) for c in "abc"])
        dynamic = [n for n, c in checks if c.by_key]
        group = F.when(F.col("n").isin(dynamic), F.col("key")).otherwise("").alias("group") if dynamic else F.lit("").alias("group")
        kinds = sorted({c.metric for _, c in checks})
        found = by_key.groupBy("n", group).agg(*[F.expr(kind).cast("long").alias(f"m{k}") for k, kind in enumerate(kinds)])
        metric = F.coalesce(*[F.when(F.col("n").isin([n for n, c in checks if c.metric == kind]), F.col(f"m{k}")) for k, kind in enumerate(kinds)])
        named = spark.createDataFrame([(n, c.table, c.name, c.threshold, c.details, c.bad, c.by_key) for n, c in checks], "n int, table_name string, check_name string, threshold string, details string, bad string, by_key boolean")
        rows = named.join(found.withColumn("metric", metric), "n", "left").where("not by_key or metric is not null")
        groups = F.from_json("group", "array<string>")
        where = F.concat(F.lit("source="), F.coalesce(groups[0], F.lit("")), F.lit(" promotion="), F.coalesce(groups[1], F.lit("")))
        value = F.coalesce("metric", F.lit(0)).cast("double")
        parts.append(rows.select(F.when(value == 0, "pass").otherwise(F.col("bad")).alias("status"), "table_name", "check_name", value.alias("metric_value"), "threshold", F.when(F.col("by_key"), where).otherwise(F.col("details")).alias("details")))
    wrong = [(name, schema_mismatches(tables[name], STAGING[name])) for name in SCHEMAS if name in tables]
    if wrong:
        said = [("fail" if w else "pass", name, "schema_types_match", float(len(w)), "0", "declared schema types must match" + (": " + ", ".join(w) if w else "")) for name, w in wrong]
        parts.append(spark.createDataFrame(said, "status string, table_name string, check_name string, metric_value double, threshold string, details string"))
    if pit is not None:
        parts.append(pit)
    return standard(union_all(parts))


def fight_view(fights: DataFrame, events: DataFrame, participants: DataFrame, stats: DataFrame, pit: DataFrame, matchups: DataFrame) -> DataFrame:
    """Every bout of a known event with what the other tables hold of it, and what is wrong with that.

    The four tables are united as counters and grouped by bout once.
    """
    red, blue = F.col("corner") == "red", F.col("corner") == "blue"
    one = lambda df, name: df.select("fight_id", F.lit(1).alias(name))
    every = participants.select("fight_id", F.lit(1).alias("participant_count"), red.cast("int").alias("red_count"), blue.cast("int").alias("blue_count"), F.when(red, F.col("fighter_id")).alias("red_fighter_id"), F.when(blue, F.col("fighter_id")).alias("blue_fighter_id"))
    for df, name in ((stats, "stats_row_count"), (pit, "pit_row_count"), (matchups, "matchup_row_count")):
        every = every.unionByName(one(df, name), allowMissingColumns=True)
    names = ("participant_count", "red_count", "blue_count", "stats_row_count", "pit_row_count", "matchup_row_count")
    counts = every.groupBy("fight_id").agg(*[F.sum(c).alias(c) for c in names], F.min("red_fighter_id").alias("red_fighter_id"), F.min("blue_fighter_id").alias("blue_fighter_id"))
    held = fights.join(events.select("event_id", "event_date", F.col("name").alias("event_name")), "event_id").join(counts, "fight_id", "left")
    held = held.withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
    right = (F.col("participant_count") == 2) & (F.col("red_count") == 1) & (F.col("blue_count") == 1)
    tests = {
        "participant_count": F.col("participant_count") != 2, "red_count": F.col("red_count") != 1, "blue_count": F.col("blue_count") != 1,
        "pit_rows": F.col("pit_row_count") != F.col("participant_count"), "matchup_rows": F.col("matchup_row_count") != right.cast("int"),
    }
    flags = F.concat_ws(";", *[F.when(test, F.lit(name)) for name, test in tests.items()])
    own = ("source", "source_fight_id", "source_event_id", "promotion", "weight_class", "method", "round", "time", "referee")
    return held.select("fight_id", "event_id", "event_date", "event_name", *[c for c in own if c in fights.columns], "red_fighter_id", "blue_fighter_id", *names, (flags != "").alias("has_anomaly"), flags.alias("anomaly_flags"))
