"""Reads and edits behind a review screen: filtered pages, search, name resolution, identity decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutframe.functions.text import name_key
from boutframe.operators.trigrams import TrigramIndex

#: Columns whose filter is a case-insensitive search for a part of the value.
PARTIAL = ("promotion", "reason", "details")
MOST = 500


class NotFound(KeyError):
    """No such row or fighter."""


class Conflict(ValueError):
    """A decision contradicts one that is stored, or a name fits several fighters."""


def contains(column: str, text: str, raw: bool = False) -> Column:
    """Case-insensitive search; ``%`` and ``_`` in the text are plain characters unless ``raw``."""
    if not raw:
        for special in ("\\", "%", "_"):
            text = text.replace(special, "\\" + special)
    return F.col(column).ilike(f"%{text}%")


def filters(df: DataFrame, wanted: dict[str, str | None], raw: bool = False) -> Column:
    """All conditions together: unknown columns and empty values are ignored, booleans are parsed."""
    kinds, test = dict(zip(df.columns, (f.dataType for f in df.schema), strict=True)), F.lit(True)
    for column, value in wanted.items():
        if column not in kinds or value in (None, ""):
            continue
        if column in PARTIAL:
            test &= contains(column, value, raw)
        elif isinstance(kinds[column], T.BooleanType):
            test &= F.col(column) == F.lit(str(value).strip().lower() in ("true", "1", "yes"))
        else:
            test &= F.col(column) == F.lit(value).cast(kinds[column])
    return test


def page(df: DataFrame, wanted: dict | None = None, limit: int = 100, offset: int = 0, order: tuple[str, ...] = (), raw: bool = False) -> DataFrame:
    """A page in a fixed order (all columns where none is given); limit 1 to 500, offset not negative."""
    rows = df.where(filters(df, wanted or {}, raw)).orderBy(*(order or df.columns))
    return rows.offset(max(0, offset)).limit(max(1, min(MOST, limit)))


def search(fighters: DataFrame, text: str, limit: int = 25, names: TrigramIndex | None = None, keys: TrigramIndex | None = None) -> DataFrame:
    """Fighters whose name or name key holds the text.

    With indexes of both by ``fighter_id`` (:func:`name_indexes`) the fighters are looked up by rare trigrams instead of read through.
    """
    key = name_key(F.lit(text))
    if names is None or keys is None:
        hit = contains("full_name", text) | F.contains(name_key(F.col("full_name")), key)
        return fighters.where(hit).orderBy("full_name", "fighter_id").limit(limit)
    one = fighters.sparkSession.range(1)
    whole = lambda part: F.concat(F.lit("%"), F.regexp_replace(part, r"([\\%_])", r"\\$1"), F.lit("%"))
    found = names.search(one.select(whole(F.lit(text)).alias("pattern"))).select("id").unionByName(keys.search(one.select(whole(key).alias("pattern"))).select("id"))
    return fighters.join(found.select(F.col("id").alias("fighter_id")).distinct(), "fighter_id", "left_semi").orderBy("full_name", "fighter_id").limit(limit)


def name_indexes(fighters: DataFrame) -> tuple[TrigramIndex, TrigramIndex]:
    """Indexes of names and of name keys for :func:`search`."""
    keyed = fighters.select("fighter_id", "full_name", name_key(F.col("full_name")).alias("key"))
    return TrigramIndex.build(keyed, "fighter_id", "full_name"), TrigramIndex.build(keyed, "fighter_id", "key")


def resolve(wanted: DataFrame, fighters: DataFrame, prefer: str) -> DataFrame:
    """``query`` to ``fighter_id``: an exact id, else a name in any case (the preferred source first); ``matches`` over 1 is ambiguous."""
    by_id = wanted.join(fighters.select(F.col("fighter_id").alias("query"), F.lit(0).alias("rank"), "fighter_id"), "query")
    names = fighters.select(F.lower("full_name").alias("name"), "fighter_id", F.when(F.col("source") == prefer, 1).otherwise(2).alias("rank"))
    by_name = wanted.join(names, F.lower("query") == F.col("name")).select("query", "rank", "fighter_id")
    found = by_id.unionByName(by_name)
    best = found.groupBy("query").agg(F.min("rank").alias("best"))
    kept = found.join(best, "query").where("rank = best").groupBy("query").agg(F.min("fighter_id").alias("fighter_id"), F.count_distinct("fighter_id").alias("matches"))
    return wanted.join(kept, "query", "left").select("query", "fighter_id", F.coalesce("matches", F.lit(0)).alias("matches"))


def resolve_one(wanted: str, fighters: DataFrame, prefer: str):
    row = resolve(fighters.sparkSession.createDataFrame([(wanted,)], "query string"), fighters, prefer).first()
    if row["matches"] == 0:
        raise NotFound(wanted)
    if row["matches"] > 1:
        raise Conflict(f"{wanted} fits {row['matches']} fighters")
    return row["fighter_id"]


def save_decision(store, row: dict, stamp: str, table: str = "fighter_identity_manual_overrides") -> None:
    """Store a decision; two approved targets, or approval and acceptance as unresolved, of one fighter conflict."""
    if row["decision"] not in ("approved", "rejected", "accepted_unresolved"):
        raise ValueError(row["decision"])
    if (row["decision"] == "accepted_unresolved") == bool(row.get("target_source_fighter_id")):
        raise ValueError("a target goes with approved and rejected only")
    own = store.read(table).where((F.col("source") == row["source"]) & (F.col("source_fighter_id") == row["source_fighter_id"]) & F.col("decision").isin("approved", "accepted_unresolved"))
    if row["decision"] != "rejected" and not own.where(~F.col("target_source_fighter_id").eqNullSafe(F.lit(row.get("target_source_fighter_id")))).isEmpty():
        raise Conflict("the fighter has another decision")
    store.upsert(table, row, ["source", "source_fighter_id", "target_source", "target_source_fighter_id"], stamp)


def records(rows: DataFrame) -> DataFrame:
    """The rows with ``record``, their JSON text: a number that is none or not finite is null, and nulls are written."""
    kinds = {f.name: f.dataType for f in rows.schema}
    odd = lambda c: F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
    clean = [F.when(~odd(c), F.col(c)).alias(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(c) for c, kind in kinds.items()]
    return rows.withColumn("record", F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}))


def decision_targets(review: DataFrame, fighters: DataFrame, rejected: DataFrame, source_fighter_id: str, text: str = "", most: int = 10) -> DataFrame:
    """Whom a fighter under review may be linked with: suggested candidates first, then names that hold ``text``; rejected ones are marked.

    ``rejected``: source_fighter_id, target_source_fighter_id. At most ``most`` rows, in a fixed order.
    """
    own = review.where(F.col("source_fighter_id") == source_fighter_id)
    ids = own.select(F.explode(F.split("candidate_source_fighter_ids", ", ")).alias("fighter_id")).withColumn("suggested", F.lit(True))
    found = fighters.where(contains("full_name", text)) if text else fighters.where("false")
    every = found.join(ids.select("fighter_id"), "fighter_id", "left_anti").withColumn("suggested", F.lit(False)).unionByName(fighters.join(ids, "fighter_id"))
    no = rejected.where(F.col("source_fighter_id") == source_fighter_id).select(F.col("target_source_fighter_id").alias("fighter_id"), F.lit(True).alias("is_rejected")).distinct()
    return every.join(no, "fighter_id", "left").withColumn("is_rejected", F.coalesce("is_rejected", F.lit(False))).orderBy(F.desc("suggested"), "full_name", "fighter_id").limit(most)
