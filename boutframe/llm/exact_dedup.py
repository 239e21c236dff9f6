"""Exact dedup with counting quotient filters.

Each input partition builds counting quotient filters (CQFs) over 64-bit fingerprints, one for each range of the
fingerprint space. The filters of a range merge without loss, because a filter lists its fingerprints (quotient and
remainder together hold all 64 bits) in sorted order. Fingerprints whose merged count is above one go on to byte
verification: the rows that may carry such a fingerprint are grouped by the normalised text itself, with partial sums
on the map side, so a group of any size leaves one row per task. A fixed-size bitmap of the repeated fingerprints
(``bitmap_bits``, so its broadcast has a proven bound) only decides which rows skip verification; its false positives
are verified like any other row. A verified group is then named by its SHA-256, by which its rows find it again: groups
with over a ``1 / HOT``-th of all grouped rows, of which there are fewer than ``HOT``, are broadcast, the others are joined.

Cases: a null text counts as empty; empty texts equal each other; a null doc_id sorts below all others and a group of
nulls only has a null keep_id; rows that repeat both doc_id and text count one by one in group_size and all carry
``kept``, while :func:`drop_exact_duplicates` lets one of them through; empty tables and empty partitions give no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe.llm.idfilter import bitmap, hits, join_counted, spare
from boutframe.session import materialize, ship

BITMAP_BITS = 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class CountingQuotientFilter:
    """A counting quotient filter over ``q + r``-bit fingerprints, built in bulk and losslessly mergeable.

    A fingerprint's high q bits (quotient) name its home slot, its low r bits (remainder) are stored. Runs are kept in
    order by linear probing; ``occupied`` marks quotients that have a run, ``run_end`` the last slot of each run, and
    ``counter`` the slots that hold the count of the remainder before them (present when that count is above one).
    """

    def __init__(self, q: int, r: int, occupied: np.ndarray, run_end: np.ndarray, counter: np.ndarray, slots: np.ndarray):
        self.q, self.r = q, r
        self.occupied, self.run_end, self.counter, self.slots = occupied, run_end, counter, slots

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, bits: int = 64) -> CountingQuotientFilter:
        """From fingerprints in any order, with repeats, or from distinct ascending ones with their ``counts``."""
        prints = np.asarray(fingerprints, np.uint64)
        if counts is None:
            prints, counts = np.unique(prints, return_counts=True)
        counts = counts.astype(np.uint64)
        wide = 1 + (counts > 1).astype(np.int64)
        total = int(wide.sum())
        q = max(1, int(np.ceil(np.log2(max(total, 1) / 0.85))))
        q = min(q, bits - 1)
        r = bits - q
        quotient = (prints >> np.uint64(r)).astype(np.int64)
        remainder = prints & np.uint64((1 << r) - 1)
        first = np.cumsum(wide) - wide  # rank of each remainder's slot when nothing is shifted
        at = first + np.maximum.accumulate(quotient - first) if len(prints) else first
        size = max(1 << q, int(at[-1] + wide[-1]) if len(prints) else 0)
        slots, counter, run_end = np.zeros(size, np.uint64), np.zeros(size, bool), np.zeros(size, bool)
        slots[at] = remainder
        many = wide == 2
        slots[at[many] + 1], counter[at[many] + 1] = counts[many], True
        last = np.append(quotient[1:] != quotient[:-1], True) if len(prints) else np.zeros(0, bool)
        run_end[(at + wide - 1)[last]] = True
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        used = np.zeros(size, bool)
        used[at], used[at[many] + 1] = True, True
        made = cls(q, r, occupied, run_end, counter, slots[used])
        made.run_end, made.counter = run_end[used], counter[used]  # empty slots are implied by the quotients
        return made

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints in ascending order, with their counts."""
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)
        run = np.cumsum(self.run_end) - self.run_end
        heads = ~self.counter
        prints = (quotients[run[heads]] << np.uint64(self.r)) | self.slots[heads]
        follows = np.append(self.counter[1:], False)[heads] if len(self.slots) else np.zeros(0, bool)
        counts = np.ones(len(prints), np.uint64)
        counts[follows] = self.slots[self.counter]
        return prints, counts

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter], bits: int = 64) -> CountingQuotientFilter:
        """Merge two by two in the order of the sorted remainders; counts of equal fingerprints add up, nothing is lost."""
        parts = [f.items() for f in filters] or [(np.zeros(0, np.uint64),) * 2]
        while len(parts) > 1:
            parts = [_merged(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return cls.build(*parts[0], bits)

    def to_bytes(self) -> bytes:
        """Remainders take r bits each; a counter takes the 64 bits of its own list."""
        heads = self.slots[~self.counter]
        head = np.array([self.q, self.r, len(self.slots), len(heads)], "<i8").tobytes()
        marks = b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.run_end, self.counter))
        return head + marks + _pack_bits(heads, self.r) + self.slots[self.counter].astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, r, n, heads = (int(x) for x in np.frombuffer(data, "<i8", 4))
        at, parts = 32, []
        for size in (1 << q, n, n):
            width = (size + 7) // 8
            parts.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=size).astype(bool))
            at += width
        slots, width = np.zeros(n, np.uint64), (heads * r + 7) // 8
        slots[~parts[2]] = _unpack_bits(np.frombuffer(data, np.uint8, width, at), heads, r)
        slots[parts[2]] = np.frombuffer(data, "<u8", n - heads, at + width)
        return cls(q, r, *parts, slots)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two ascending lists of fingerprints with counts as one."""
    at = np.searchsorted(a[0], b[0])
    same = at < len(a[0])
    same[same] = a[0][at[same]] == b[0][same]
    counts = a[1].copy()
    counts[at[same]] += b[1][same]
    return np.insert(a[0], at[~same], b[0][~same]), np.insert(counts, at[~same], b[1][~same])


def _pack_bits(values: np.ndarray, width: int) -> bytes:
    """``width`` bits of each value, the lowest first; 65,536 values at a time, which end at a whole byte."""
    shifts, out = np.arange(width, dtype=np.uint64), []
    for a in range(0, len(values), 1 << 16):
        bits = (values[a : a + (1 << 16), None] >> shifts) & np.uint64(1)
        out.append(np.packbits(bits.astype(np.uint8), bitorder="little").tobytes())
    return b"".join(out)


def _unpack_bits(data: np.ndarray, n: int, width: int) -> np.ndarray:
    shifts, out = np.arange(width, dtype=np.uint64), [np.zeros(0, np.uint64)]
    for a in range(0, n, 1 << 16):
        k = min(1 << 16, n - a)
        bits = np.unpackbits(data[a * width // 8 : (a * width + k * width + 7) // 8], count=k * width, bitorder="little")
        out.append((bits.reshape(k, width).astype(np.uint64) << shifts).sum(1, dtype=np.uint64))
    return np.concatenate(out)


def _digests(texts: pa.Array) -> tuple[pa.Array, list[bytes]]:
    low = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    return low, [hashlib.sha256(x.as_buffer()).digest() for x in low]


def _prints(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)


def _blocks(batches: Iterator[pa.RecordBatch], range_bits: int) -> Iterator[pa.RecordBatch]:
    """One filter for each fingerprint range this partition meets."""
    seen = [np.zeros(0, np.uint64)]
    for batch in batches:
        seen.append(_prints(_digests(batch.column(0))[1]))
    prints = np.sort(np.concatenate(seen))
    if not len(prints):
        return
    ranges = (prints >> np.uint64(64 - range_bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(ranges, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(prints)], strict=True):
        data = CountingQuotientFilter.build(prints[a:b] & np.uint64((1 << (64 - range_bits)) - 1), bits=64 - range_bits).to_bytes()
        yield pa.RecordBatch.from_arrays([pa.array([int(ranges[a])], pa.int32()), pa.array([data], pa.binary())], names=["fp_range", "block"])


def _repeated(key: int, table: pa.Table, range_bits: int) -> pa.Table:
    """Merge one range's filters; returns its fingerprints with counts above one."""
    merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x.as_py()) for x in table.column("block")], 64 - range_bits)
    prints, counts = merged.items()
    prints = (prints | np.uint64(key << (64 - range_bits)))[counts > 1]
    return pa.table({"fp": pa.array(prints.view(np.int64)), "copies": pa.array(counts[counts > 1].astype(np.int64))})


def repeated_fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``fp, copies`` of each 64-bit fingerprint that more than one row carries."""
    ship(docs.sparkSession)
    bits = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()  # a range or two for each task

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(batches, bits)

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _repeated(key[0].as_py(), table, bits)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(blocks, "fp_range int, block binary").groupBy("fp_range").applyInArrow(merged, "fp long, copies long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. See the module's docstring for the cases."""
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    flags = spark.sparkContext.broadcast(bitmap(repeated_fingerprints(slim).select("fp"), bitmap_bits))

    def keys(batches):
        for batch in batches:
            digests = _digests(batch.column(1))[1]
            hit = pa.array(hits(flags.value, _prints(digests), bitmap_bits))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d.hex() for d in digests], pa.string()), hit], names=["doc_id", "text_sha256", "doubtful"])

    def routed(batches):
        for batch in batches:
            low, digests = _digests(batch.column(1))
            hit = pa.array(hits(flags.value, _prints(digests), bitmap_bits))
            sha = pa.array([d.hex() for d in digests], pa.string())
            yield pa.RecordBatch.from_arrays([x.filter(hit) for x in (batch.column(0), sha, low.cast(pa.string()))], names=["doc_id", "text_sha256", "norm"])

    verified = (
        slim.mapInArrow(routed, "doc_id long, text_sha256 string, norm string")
        .groupBy("text_sha256", "norm")  # equality of the bytes decides; SHA-256 then only names the group
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("text_sha256", "keep_id", "group_size")
    )
    verified = materialize(verified, "groups")
    rows = materialize(slim.mapInArrow(keys, "doc_id long, text_sha256 string, doubtful boolean"), "digests")
    alone = rows.where("not doubtful").select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    grouped = join_counted(rows.where("doubtful").drop("doubtful"), verified, "text_sha256", "group_size")
    return alone.unionByName(grouped).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """The input rows that stay, with all their columns: of equal texts one row with the largest doc_id.

    Rows whose fingerprint is not repeated stay where they are; only the others are moved to be verified. The join that picks
    the row to stay is by text *and* id, so a group of any size spreads over all tasks.
    """
    spark = docs.sparkSession
    ship(spark)
    flags = spark.sparkContext.broadcast(bitmap(repeated_fingerprints(docs, text_col).select("fp"), bitmap_bits))
    place = docs.columns.index(text_col)
    norm_name, sha, keep, name = (spare(docs.columns, x) for x in ("norm", "sha", "keep", "name"))

    def pick(wanted: bool):
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(hits(flags.value, _prints(_digests(batch.column(place))[1]), bitmap_bits) == wanted))

        return run

    plain, doubtful = docs.mapInArrow(pick(False), docs.schema), docs.mapInArrow(pick(True), docs.schema)
    norm = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    best = doubtful.groupBy(norm.alias(norm_name)).agg(F.max(id_col).alias(keep)).select(F.sha2(norm_name, 256).alias(name), keep)
    stay = doubtful.withColumn(sha, F.sha2(norm, 256))
    stay = stay.join(best, (F.col(sha) == F.col(name)) & F.col(id_col).eqNullSafe(F.col(keep)), "left_semi")
    return plain.unionAll(stay.dropDuplicates([id_col, sha]).drop(sha))


def oracle(table: str = "documents") -> str:
    """The same rows as DuckDB SQL."""
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return f"""
        WITH n AS (SELECT doc_id, {low} AS norm FROM {table}),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
        FROM n JOIN g ON n.norm = g.norm"""
