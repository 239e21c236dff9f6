"""File sources and sinks: Parquet, CSV, JSON documents, JSON lines, trees of HTML files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutframe.schemas import columns, conform, empty

MANIFEST = columns("entity string, entity_id string, url string, path string, status int, sha256 string, fetched_at_utc string")
CARD = columns("event_date date, fighter_a string, fighter_b string")


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The file's columns in the schema's order; a missing file is an empty table."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return empty(spark, schema)
    return conform(spark.read.parquet(path), schema)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = CARD) -> DataFrame:
    """A CSV file with a header; columns that the schema asks for must be there."""
    raw = spark.read.option("header", True).csv(path)
    if lacking := [f.name for f in schema if f.name not in raw.columns]:
        raise ValueError(f"{path} lacks the columns {', '.join(lacking)}")
    return conform(raw, schema)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header: for small reports only."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_json(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as file:
        json.dump(report, file, indent=2, sort_keys=True, default=str)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    conform(rows, MANIFEST).write.mode("append").json(path)


def read_html_tree(spark: SparkSession, path: str) -> DataFrame:
    """``entity_id, path, html`` of every page below a folder; the id is the file's stem."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(path, wholetext=True)
    name = F.input_file_name()
    return files.select(F.regexp_extract(name, r"([^/]+)\.html$", 1).alias("entity_id"), name.alias("path"), F.col("value").alias("html"))


def tree_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes below a folder, by sub-folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
