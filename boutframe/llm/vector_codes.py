"""Vector code compression: product quantisation in integers, trained by Hamerly's form of Lloyd's rounds.

Components become integers, vectors are cut into ``PARTS`` equal parts, and each part position has a codebook of at most
``ENTRIES`` entries that starts as that part of the vectors with the smallest ids. A round assigns every part to its nearest
entry (ties to the lower index) and moves each used entry to the floor of its parts' mean.

A table in the shared folder carries, for each vector, its integers and for each part the entry, an upper bound on the distance
to it and a lower bound on the distance to the second nearest. After a move the upper bound grows by the step of its own entry
and the lower one shrinks by the largest step of another entry. Only where the upper bound is not *strictly* below both the
lower bound and half the distance from the entry to its nearest other (first as carried, then made exact) is the part scanned
against the whole codebook, in integers, so that ties are always seen. Bounds are floats widened by more than their rounding
error; distances are integers: in float64 while they are exact there (below 2^53), then in int64, then in Python's integers.

A round writes the table once and reads it once for the sums, which each task adds up by entry; sums travel in 32-bit limbs, so
that neither their size nor the number of tasks matters. The driver holds the codebooks only (``ENTRIES`` vectors); they are
broadcast. The table of the round before is dropped when the next is written.

Cases: a vector that is null, or holds null or non-finite components, is dropped. Scaled
components beyond a double count as non-finite. Equal ids are ordered by their vectors, a
null id comes last. With fewer than ``ENTRIES`` vectors every vector is an entry. A vector shorter than the longest (rounded
up to a multiple of ``PARTS``) is padded with zeros; empty vectors have code 00 in each part and no error. Repeated rows are
coded each. An error beyond a long is null, and so is a sum of errors beyond a long or over such an error. Null labels are one
label. An empty table gives no rows. Only id, vector and label are read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe.session import drop_scratch, materialize, ship

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BLOCK = 4096
CODED = "vec_id long, label string, vector array<double>, entry array<int>, upper array<double>, lower array<double>"
SLACK = 1e-9


def integers(scaled: np.ndarray) -> np.ndarray:
    """Floors of scaled components: int64 while a batch of them can be added up in that, else Python's integers."""
    if scaled.size and np.abs(scaled).max() >= 2.0**48:
        return np.array([math.floor(x) for x in scaled.tolist()], object)
    return np.floor(scaled).astype(np.int64)


def _kind(x: np.ndarray, c: np.ndarray):
    """The cheapest numbers in which squared distances of parts of ``x`` and ``c`` are exact."""
    most = max([1, *(int(abs(v)) for a in (x, c) if a.size for v in (a.max(), a.min()))])
    bound = 4 * most * most * max(1, x.shape[-1])
    return np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all entries ``c``, exact."""
    kind = _kind(x, c)
    x, c = x.astype(kind), c.astype(kind)
    if kind is np.float64:
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]
    return np.stack([((x - e) ** 2).sum(1) for e in c], 1) if x.shape[1] else np.zeros((len(x), len(c)), kind)


def _own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries of their own, exact."""
    kind = _kind(x, c)
    return ((x.astype(kind) - c.astype(kind)) ** 2).sum(1) if x.shape[1] else np.zeros(len(x), kind)


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


class Codebooks:
    """The entries of each part (``PARTS`` x entries x part length) and what a round's bounds need to know of the last move."""

    def __init__(self, entries: list[np.ndarray], before: list[np.ndarray] | None = None):
        self.entries, self.own, self.other, self.half = entries, [], [], []
        for k, c in enumerate(entries):
            n = len(c)
            step = _roots(_own(c, before[k])) * (1 + SLACK) + SLACK if before else np.zeros(n)
            top = np.sort(step)[-2:] if n > 1 else np.array([0.0, *step])
            self.own.append(step)
            self.other.append(np.where(step == top[-1], top[-2] if n > 1 and (step == top[-1]).sum() == 1 else top[-1], top[-1]) if n > 1 else np.zeros(n))
            apart = _roots(distances(c, c)) if n else np.zeros((0, 0))
            np.fill_diagonal(apart, np.inf)
            self.half.append((apart.min(1) if n > 1 else np.full(n, np.inf)) / 2 * (1 - SLACK))

    def scan(self, part: int, x: np.ndarray):
        """Nearest entry, upper bound and second-nearest lower bound by the whole codebook, block by block."""
        entry, upper, lower = np.zeros(len(x), np.int32), np.zeros(len(x)), np.full(len(x), np.inf)
        for at in range(0, len(x), BLOCK):
            d = distances(x[at : at + BLOCK], self.entries[part])
            best = d.argmin(1)  # the first of equal ones
            rows = np.arange(len(d))
            entry[at : at + BLOCK], upper[at : at + BLOCK] = best, _roots(d[rows, best]) * (1 + SLACK) + SLACK
            if d.shape[1] > 1:
                d = d.astype(np.float64)
                d[rows, best] = np.inf
                lower[at : at + BLOCK] = np.sqrt(d.min(1)) * (1 - SLACK) - SLACK
        return entry, upper, lower

    def assign(self, part: int, x: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """The same as :meth:`scan` from the last round's entries and bounds, and how many parts were scanned."""
        upper, lower = upper + self.own[part][entry], lower - self.other[part][entry]
        safe = np.maximum(lower, self.half[part][entry])
        doubt = np.flatnonzero(~(upper < safe))
        if doubt.size:
            upper[doubt] = _roots(_own(x[doubt], self.entries[part][entry[doubt]])) * (1 + SLACK) + SLACK
            doubt = doubt[~(upper[doubt] < safe[doubt])]
        if doubt.size:
            entry = entry.copy()
            entry[doubt], upper[doubt], lower[doubt] = self.scan(part, x[doubt])
        return entry, upper, lower, doubt.size


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(values: np.ndarray, kind) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * width, width) if width else np.zeros(rows + 1), pa.int32()), pa.array(values.ravel(), kind))


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, vector`` without vectors that are null or hold null or non-finite components; scaled, labels as text."""
    number = F.transform(vector_col, lambda x: x.cast("double") * F.lit(float(scale)))
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), number.alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def first_codebooks(rows: DataFrame, width: int, entries: int = ENTRIES, parts: int = PARTS) -> Codebooks:
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    whole = integers(np.array([r["vector"] for r in first], np.float64).reshape(-1)).reshape(len(first), width)
    return Codebooks([whole[:, k * width // parts : (k + 1) * width // parts] for k in range(parts)])


def _assigned(rows: DataFrame, books: Codebooks, width: int, parts: int, final: bool) -> DataFrame:
    """A round's assignment. ``final`` gives ``vec_id, label, code, error``, else the table that the next round reads."""
    shared, size = rows.sparkSession.sparkContext.broadcast(books), width // parts
    fresh = "entry" not in rows.columns

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = integers(_matrix(batch.column(2), width).ravel()).reshape(n, width)
            entry, upper, lower = np.zeros((n, parts), np.int32), np.zeros((n, parts)), np.zeros((n, parts))
            if not fresh:
                entry[:], upper[:], lower[:] = (_matrix(batch.column(k), parts) for k in (3, 4, 5))
            for k in range(parts):
                piece = x[:, k * size : (k + 1) * size]
                found = shared.value.scan(k, piece) if fresh else shared.value.assign(k, piece, entry[:, k], upper[:, k], lower[:, k])
                entry[:, k], upper[:, k], lower[:, k] = found[:3]
            if not final:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], _lists(x.astype(np.float64), pa.float64()), _lists(entry, pa.int32()), _lists(upper, pa.float64()), _lists(lower, pa.float64())], names=["vec_id", "label", "vector", "entry", "upper", "lower"])
                continue
            errors = sum(_own(x[:, k * size : (k + 1) * size], shared.value.entries[k][entry[:, k]]).astype(object) for k in range(parts))
            codes = ["".join(f"{e:02x}" for e in row) for row in entry.tolist()]
            whole = [int(e) if int(e) < 2**63 else None for e in errors.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(codes, pa.string()), pa.array(whole, pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, "vec_id long, label string, code string, error long" if final else CODED)


def _limbs(total) -> list[int]:
    out = []
    while not -(1 << 31) <= total < 1 << 31:
        out.append(total & 0xFFFFFFFF)
        total >>= 32
    return [*out, total]


def moved(table: DataFrame, books: Codebooks, width: int, parts: int = PARTS) -> Codebooks:
    """Each used entry at the floor of its parts' mean."""
    size, entries = width // parts, len(books.entries[0])

    def run(batches):
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(_matrix(batch.column(0), width).ravel()).reshape(batch.num_rows, width)
            at = _matrix(batch.column(1), parts)
            for k in range(parts):
                order = np.argsort(at[:, k], kind="stable")
                used, starts = np.unique(at[order, k], return_index=True)
                counts[k] += np.bincount(at[:, k], minlength=entries)
                if size:
                    sums[k, used] += np.add.reduceat(x[order, k * size : (k + 1) * size], starts, axis=0)
        cells = [(k, e, -1, 0, int(counts[k, e])) for k, e in np.argwhere(counts).tolist()]
        cells += [(k, e, d, n, limb) for k, e, *_ in cells for d in range(size) for n, limb in enumerate(_limbs(int(sums[k, e, d])))]
        names = ["part", "entry", "place", "limb", "total"]
        yield pa.RecordBatch.from_arrays([pa.array([c[n] for c in cells], pa.int64() if name == "total" else pa.int32()) for n, name in enumerate(names)], names=names)

    sums = table.select("vector", "entry").mapInArrow(run, "part int, entry int, place int, limb int, total long").groupBy("part", "entry", "place", "limb").agg(F.sum("total").alias("total"))
    totals: dict[tuple, int] = {}
    for part, entry, place, limb, total in zip(*(c.to_pylist() for c in sums.toArrow().columns), strict=True):  # as many as the codebooks have components, by limb
        totals[part, entry, place] = totals.get((part, entry, place), 0) + (total << (32 * limb))
    after = []
    for k, before in enumerate(books.entries):
        new = before.astype(object)
        for e in range(len(before)):
            if count := totals.get((k, e, -1), 0):
                new[e] = [totals.get((k, e, d), 0) // count for d in range(size)]
        big = any(abs(v) >= 2**62 for v in new.ravel().tolist())
        after.append(new if big else new.astype(np.int64))
    return Codebooks(after, books.entries)


def codebooks_sha256(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(int(v)) for part in books.entries for v in part.ravel().tolist()).encode()).hexdigest()


def train(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """The final codebooks, and ``vec_id, label, code, error`` of every kept vector (not yet computed); codebooks are None for an empty table."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    ship(df.sparkSession)
    rows = kept_vectors(df, id_col, vector_col, label_col, scale)
    widths = rows.agg(F.max(F.size("vector")).alias("most"), F.min(F.size("vector")).alias("least")).first()
    if widths["most"] is None:
        return None, df.sparkSession.createDataFrame([], "vec_id long, label string, code string, error long")
    width = -(-widths["most"] // parts) * parts
    if widths["least"] < width:
        rows = rows.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vector"))))
    books, table = first_codebooks(rows, width, entries, parts), rows
    for _ in range(rounds):
        later = materialize(_assigned(table, books, width, parts, False), "codes")
        if table is not rows:
            drop_scratch(table)
        books, table = moved(later, books, width, parts), later
    return books, _assigned(table, books, width, parts, True)


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", **options) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept vector."""
    books, coded = train(df, id_col, vector_col, label_col, **options)
    if books is None:
        return coded.select("vec_id", "code", "error", F.lit(None).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = materialize(coded, "coded")
    whole = F.when(F.count_if(F.col("error").isNull()) == 0, F.try_sum("error"))
    totals = coded.groupBy("label").agg(whole.alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def decode(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``codes`` with ``vector``, the middle of the integers' cells that its entries stand for."""
    shared = [[[(int(v) + 0.5) / scale for v in e] for e in part] for part in books.entries]
    pieces = [F.element_at(F.array(*[F.array(*[F.lit(v) for v in e]) for e in part]), F.conv(F.substring("code", 2 * k + 1, 2), 16, 10).cast("int") + 1) for k, part in enumerate(shared)]
    return codes.withColumn("vector", F.concat(*pieces))


def oracle(table: str = "embeddings", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same rows as DuckDB SQL, for ids without repeats and vectors of one length that ``parts`` divides."""
    steps = [
        f"v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM {table} WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT vec_id, k, unnest(q[k * len(q) // {parts} + 1 : (k + 1) * len(q) // {parts}]) AS x, unnest(range(len(q) // {parts})) AS d FROM v, range({parts}) r(k))",
        f"c0 AS MATERIALIZED (SELECT k, e, d, x AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT {entries}) USING (vec_id))",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT vec_id, k, min(s) AS s, arg_min(e, (s, e)) AS e FROM (SELECT vec_id, k, e, sum((x - c) * (x - c))::BIGINT AS s FROM x JOIN c{n} USING (k, d) GROUP BY ALL) GROUP BY ALL)")
        if n < rounds:
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT k, e, d, coalesce(floor(m), c)::BIGINT AS c FROM c{n} LEFT JOIN (SELECT k, e, d, sum(x)::DOUBLE / count(*) AS m FROM x JOIN a{n} USING (vec_id, k) GROUP BY ALL) USING (k, e, d))")
    return f"""WITH {', '.join(steps)},
        o AS (SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY k) AS code, sum(s)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
        l AS (SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error FROM o JOIN v USING (vec_id))
        SELECT l.*, (SELECT sha256(string_agg(c, ',' ORDER BY k, e, d)) FROM c{rounds}) AS codebooks_sha256 FROM l"""
