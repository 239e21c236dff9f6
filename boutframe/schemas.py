"""Column contracts of the staging and canonical tables, and how a frame is made to follow one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType()}


def columns(text: str) -> T.StructType:
    """``name type, name type``; works without a running session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in text.split(","))])


#: Names, order and types of the staging tables' columns.
STAGING = {
    "events": columns("event_id string, name string, event_date date, location string, url string"),
    "fights": columns("fight_id string, event_id string, winner_id string, method string, round int, time string, time_format string, referee string, url string"),
    "fight_participants": columns("fight_id string, event_id string, fighter_id string, opponent_id string, corner string, full_name string, winner_flag boolean, outcome string"),
    "fighters": columns("fighter_id string, full_name string, height_in int, weight_lbs int, reach_in int, stance string, dob date, url string"),
    "fighter_fight_stats": columns(
        "fight_id string, event_id string, fighter_id string, opponent_id string, corner string, kd int, sig_str_landed int, sig_str_attempted int,"
        " total_str_landed int, total_str_attempted int, td_landed int, td_attempted int, sub_att int, rev int, ctrl_sec int"
    ),
    "source_events": columns("source string, source_event_id string, name string, event_date date, location string, promotion string, url string"),
    "source_fights": columns(
        "source string, source_fight_id string, source_event_id string, promotion string, weight_class string, winner_source_fighter_id string, method string, round int, time string, time_format string, referee string, url string"
    ),
    "source_fight_participants": columns(
        "source string, source_fight_id string, source_event_id string, source_fighter_id string, opponent_source_fighter_id string, promotion string, corner string, full_name string, winner_flag boolean, outcome string"
    ),
    "source_fighters": columns("source string, source_fighter_id string, full_name string, height_in int, weight_lbs int, reach_in int, stance string, dob date, url string"),
    "parse_quarantine": columns("source string, entity_type string, source_entity_id string, promotion string, reason string, url string"),
    "fighter_identity_manual_overrides": columns(
        "source string, source_fighter_id string, target_source string, target_source_fighter_id string, decision string, note string, created_at_utc string, updated_at_utc string"
    ),
}
CHECK = columns("status string, table_name string, check_name string, metric_value double, threshold string, details string")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns in order: missing ones are null, others are cast (what can't be cast is null), extra ones go."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
