"""A sample of the catalogue against its DuckDB SQL, the entry point, and the stream."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__
from boutframe.plans import catalogue
from boutframe.streaming.records import daily_records

SF = "/root/testdata/sf0.001"
TABLES = ("nation", "region", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 5) + 0.0)
    return str(value)[:10] if isinstance(value, dt.date) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, oracle, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    result = oracle.sql(catalogue.oracle_sql()[name])
    at = [result.columns.index(c) for c in columns]
    assert len(result.columns) == len(columns)
    assert got == sorted(tuple(plain(row[k]) for k in at) for row in result.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_daily_records_of_a_stream(spark, tmp_path):
    rows = [(1, True, "2020-01-01 10:00:00"), (1, False, "2020-01-01 12:00:00"), (1, True, "2020-01-03 01:00:00"), (2, None, "2020-02-01 00:00:00")]
    df = spark.createDataFrame(rows, "fighter_id long, winner_flag boolean, event_time string").selectExpr("fighter_id", "winner_flag", "to_timestamp(event_time) AS event_time")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = daily_records(stream).writeStream.outputMode("complete").format("memory").queryName("records").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.fighter_id, str(r.day)): (r.fights, r.wins) for r in spark.table("records").collect()}
    assert got == {(1, "2020-01-01"): (2, 1), (1, "2020-01-03"): (1, 1), (2, "2020-02-01"): (1, 0)}


def test_every_name_is_resolved_and_every_bout_is_scored_as_a_card(spark):
    names = spark.read.parquet(f"{SF}/customer.parquet").select("c_name").distinct().count()
    assert catalogue.queries()["resolve_every_name"](spark, SF).count() == names
    bouts = catalogue.queries()["bout_projection"](spark, SF).where("corner = 'red'").count()
    assert catalogue.queries()["future_matchup_every"](spark, SF).count() == bouts
