"""Near duplicates: an exact join of shingle sets at Jaccard 0.8 by adaptive multi-match prefixes.

Equal sets are one *class*, named by a 64-bit key of the set; each class's set is stored once. Every task sorts the shingles
of its classes and sends them, range by range, to be counted; a *sketch* of fixed size keeps the magnitude of the count of
each shingle that two or more classes hold (a cell keeps the largest that falls on it). All classes order their shingles
alike, the rarest magnitude first, then by hash, so a set's own shingles come before those that it shares with many.

Two sets of n and m shingles that are similar enough share at least ``ceil(4 / 9 * (n + m))``, so the first shingle that they
share stands among the first ``n - ceil(0.8 n) + 1`` of either set, its *base prefix*, and leaves enough behind it in both
(``reach``). Pairs are made from base prefixes only, and only on shingles that the sketch counts twice or more. A class whose
base prefix brings many candidates by the sketch's estimate has a prefix that is ``l - 1`` shingles longer, ``l`` growing with
the logarithm of that cost; two sets share at least ``min(l_x, l_y)`` shingles of their longer prefixes, and a pair that doesn't
is not verified. Parity bitmaps of the sets then give an upper bound of the overlap that rules most other pairs out before
their sets are fetched; what is left is decided on the whole sets of 64-bit shingle hashes.

Components need fewer pairs than all links. In a *star round* each class is paired with one central class only, the one with
which it shares most base shingles among the classes that are central for one of them (fewest shingles of their own); verified
pairs are contracted to clusters and rounds are repeated on shingles that still meet different clusters, ``ROUNDS`` of them at
most. Then all pairs of classes of *different* clusters are looked at, so that no component is missed. So a group of thousands
of near copies doesn't make all its pairs. :func:`links` looks at all pairs of classes instead and returns every link.

Cases: null and empty texts and texts without words have an empty set, n_shingles 0 and are a component of their own (two
of them are not linked); shorter texts than five words are one shingle; a null doc_id takes part, and component_id is the
smallest id that is not null; repeated rows have the same component; empty tables and empty partitions give no rows; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe.llm.components import components
from boutframe.llm.idfilter import Packed, bitmap, hits, join_counted, without_ids
from boutframe.llm.words import mix, shingle_sets
from boutframe.session import materialize, ship

PERCENT = 80
#: The sketch has at most 2**SKETCH_BITS cells of four bits, so its broadcast is 32 MiB at most whatever the input.
SKETCH_BITS = 26
#: Bits of a shingle within its range that are counted; shingles that agree in them count together, which changes speed only.
COUNTED_BITS = 32
ROUNDS = 3


def need(n: int) -> int:
    """The least overlap with any set that is similar enough to one of n shingles: ceil(0.8 n)."""
    return -(-n * PERCENT // 100)


def reach(n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The largest set that one of n shingles can be similar to when the first shingle that they share is at ``place``."""
    return ((100 + PERCENT) * (n - place) - PERCENT * n) // PERCENT


def similar(shared: int, n: int, m: int) -> bool:
    return 100 * shared >= PERCENT * (n + m - shared)


def class_key(shingles: np.ndarray) -> int:
    """A key of the set, whatever the order of its shingles."""
    return int(mix(mix(shingles, 7).sum(dtype=np.uint64, keepdims=True), len(shingles))[0].astype(np.int64))


def parity_bitmap(shingles: np.ndarray) -> bytes:
    """Bit h is the parity of the number of shingles at h; as many bits as the next power of two of the set's size, 64 at least."""
    bits = max(64, 1 << (len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((mix(shingles, 3) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1).tobytes()


def _fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    while len(bitmap) > size:
        bitmap = bitmap.reshape(-1, 2, len(bitmap) // 2)[0]
        bitmap = bitmap[0] ^ bitmap[1]
    return bitmap


def may_be_similar(a: bytes, n: int, b: bytes, m: int) -> bool:
    """False only if the sets can't be similar: differing parity bits never outnumber the shingles in one set alone."""
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    differ = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())
    return similar((n + m - differ) // 2, n, m)


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two ascending arrays of distinct values share."""
    if not len(x) or not len(y):
        return 0
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


# The sketch of counts


def _counted(batches, range_bits: int, flags, flush: int = 2_000_000):
    """``range, block``: the counted bits of this task's shingles, ascending within each range, repeats kept."""

    def blocks(parts: list[np.ndarray]):
        values = np.concatenate(parts)
        values.sort()
        edges = np.searchsorted(values, np.arange(1 << range_bits, dtype=np.uint64) << np.uint64(64 - range_bits))
        low = (values >> np.uint64(64 - range_bits - COUNTED_BITS)).astype("<u4")
        for k, (a, b) in enumerate(zip(edges, np.append(edges[1:], len(values)), strict=True)):
            if a < b:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([low[a:b].tobytes()], pa.binary())], names=["range", "block"])

    parts, size = [], 0
    for batch in batches:
        for data in _fresh(batch, flags).column("shingles"):
            parts.append(np.frombuffer(data.as_buffer(), np.uint64))
            size += len(parts[-1])
        if size > flush:
            yield from blocks(parts)
            parts, size = [], 0
    if size:
        yield from blocks(parts)


def _cells(table: pa.Table, range_bits: int, sketch_bits: int) -> bytes:
    """A range's part of the sketch: two cells a byte, each the magnitude of the largest count above one that falls on it."""
    values = np.concatenate([np.frombuffer(block.as_buffer(), "<u4") for block in table.column("block")])
    values.sort()
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    counts = np.diff(np.append(first, len(values)))
    many = counts > 1
    cells = np.zeros(1 << (sketch_bits - range_bits), np.uint8)
    np.maximum.at(cells, values[first[many]] >> np.uint32(COUNTED_BITS - sketch_bits + range_bits), np.minimum(15, np.log2(counts[many])).astype(np.uint8))
    return (cells[::2] | cells[1::2] << 4).tobytes()


def sketch(sets: DataFrame, flags, shingles: int) -> Packed:
    """The sketch of the shingles of all ``sets`` (see :func:`_fresh`), with up to ``2**SKETCH_BITS`` cells, four or more for each shingle if there are few."""
    spark, bits = sets.sparkSession, min(SKETCH_BITS, max(16, (4 * shingles).bit_length()))
    range_bits = min(bits - 1, max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())  # two ranges or more for each task

    def blocks(batches):
        return _counted(batches, range_bits, flags)

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([_cells(table, range_bits, bits)], pa.binary())})

    rows = sets.mapInArrow(blocks, "range int, block binary").groupBy("range").applyInArrow(merged, "range int, cells binary").toArrow()
    out = np.zeros((1 << range_bits, (1 << (bits - 1)) >> range_bits), np.uint8)  # 32 MiB in all
    for k, data in zip(rows.column("range").to_pylist(), rows.column("cells"), strict=True):
        out[k] = np.frombuffer(data.as_buffer(), np.uint8)
    return Packed(out.reshape(-1))


def magnitudes(cells: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """0 for a shingle that one class holds, else the whole part of the logarithm (base 2) of an estimate of the count."""
    at = shingles >> np.uint64(64 - len(cells).bit_length())
    return (cells[(at >> np.uint64(1)).astype(np.int64)] >> ((at & np.uint64(1)) << np.uint64(2)).astype(np.uint8)) & 15


def prefix(shingles: np.ndarray, magnitude: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The longer prefix in order with its magnitudes, the length of the base prefix, and l."""
    n = len(shingles)
    base = n - need(n) + 1
    order = np.argsort(magnitude, kind="stable")[: base + n.bit_length() + 32]  # sorted by hash already
    weight = np.where(magnitude[order[:base]] > 0, 1 << magnitude[order[:base]].astype(np.int64), 0).sum()
    matches = min(need(n), 1 + int(np.log2(1 + weight / base)))
    chosen = order[: base + matches - 1]
    return shingles[chosen], magnitude[chosen], base, matches


# Sets and prefixes of classes


def _sets(batches):
    """A row for each document; the first document of each class in a task brings the set."""
    seen = set()
    for batch in batches:
        sizes, keys, data = [], [], []
        for shingles in shingle_sets(batch.column(1).to_pylist()):
            key = class_key(shingles) if len(shingles) else None
            sizes.append(len(shingles))
            keys.append(key)
            data.append(shingles.tobytes() if key is not None and key not in seen else None)
            seen.add(key)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "n", "class", "shingles"])


def _fresh(batch: pa.RecordBatch, flags) -> pa.RecordBatch:
    """Of rows ``class, shingles, first`` the ones to count: those that are ``first`` in their task only where no other task has the class."""
    found = hits(flags.value, batch.column("class").to_numpy().view(np.uint64))
    return batch.filter(pa.array(~(found & batch.column("first").to_numpy(zero_copy_only=False))))


class _Corpus:
    """``rows`` (doc_id, n, class), ``sets`` (class, shingles, first; one row a class once it went through :func:`_fresh`), ``profiles`` and ``postings``."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        spark = docs.sparkSession
        ship(spark)
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        whole = materialize(texts.mapInArrow(_sets, "doc_id long, n long, class long, shingles binary"), "sets")
        self.rows = whole.select("doc_id", "n", "class")
        given = whole.where("shingles is not null")
        again = given.groupBy("class").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("class")
        self.flags = flags = spark.sparkContext.broadcast(bitmap(again))

        def doubtful(batches):
            for batch in batches:
                yield batch.filter(pa.array(hits(flags.value, batch.column(0).to_numpy().view(np.uint64))))

        several = given.select("class", "shingles").mapInArrow(doubtful, "class long, shingles binary").groupBy("class").agg(F.first("shingles").alias("shingles"))
        self.sets = given.select("class", "shingles", F.lit(True).alias("first")).unionByName(materialize(several, "sets").withColumn("first", F.lit(False)))
        self.least = materialize(self.rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least_id")), "classes")
        size = given.agg(F.sum("n")).first()[0] or 0
        cells = spark.sparkContext.broadcast(sketch(self.sets, flags, size))

        def prefixes(batches):
            for batch in batches:
                batch = _fresh(batch, flags)
                keys, sizes, own, matches, tokens, bitmaps, posted = [], [], [], [], [], [], []
                held = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("shingles")]
                level = magnitudes(cells.value.array, np.concatenate(held)) if held else None
                at = 0
                for key, shingles in zip(batch.column("class").to_pylist(), held, strict=True):
                    mine = level[at : at + len(shingles)]
                    at += len(shingles)
                    chosen, magnitude, base, least = prefix(shingles, mine)
                    if not magnitude[base - 1]:
                        continue  # no shingle of the base prefix is held by another class
                    keys.append(key)
                    sizes.append(len(shingles))
                    own.append(int((mine == 0).sum()))
                    matches.append(least)
                    first = int((magnitude[:base] == 0).sum())
                    posted.append([(int(t), k) for k, t in zip(range(first, base), chosen[first:base].view(np.int64), strict=True)])
                    tokens.append(np.sort(chosen).tobytes())
                    bitmaps.append(parity_bitmap(shingles))
                kind = pa.list_(pa.struct([("token", pa.int64()), ("place", pa.int64())]))
                columns = [pa.array(c, t) for c, t in ((keys, pa.int64()), (sizes, pa.int64()), (own, pa.int64()), (matches, pa.int64()))]
                flat = pa.array([x for p in posted for x in p], kind.value_type)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, posted)]), pa.int32()), flat).cast(kind)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(tokens, pa.binary()), pa.array(bitmaps, pa.binary()), lists], names=["class", "n", "own", "l", "tokens", "bitmap", "posted"])

        schema = "class long, n long, own long, l long, tokens binary, bitmap binary, posted array<struct<token:long,place:long>>"
        self.profiles = materialize(self.sets.mapInArrow(prefixes, schema), "profiles")
        cells.unpersist()
        posted = self.profiles.select("class", "n", "own", F.explode("posted").alias("x")).select("class", "n", "own", F.col("x.token").alias("token"), F.col("x.place").alias("place"))
        reached = (100 + PERCENT) * (F.col("n") - F.col("place")) - PERCENT * F.col("n")
        posted = posted.select("token", "class", "n", "own", F.floor(reached / PERCENT).cast("long").alias("reach"))
        self.tokens, self.postings = _shared(posted.withColumn("cluster", F.col("class")), "postings", "class")


def _shared(postings: DataFrame, name: str, by: str) -> tuple[DataFrame, DataFrame]:
    """Tokens that meet two values of ``by`` or more, with their central class; and the postings of these tokens."""
    centre = F.min(F.struct("own", "class", "n", "reach", F.col(by).alias("group"))).alias("central")
    tokens = postings.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.min(by).alias("low"), F.max(by).alias("high"), centre)
    tokens = materialize(tokens.where("low <> high").select("token", "held", F.col("central.class").alias("centre"), F.col("central.n").alias("n_c"), F.col("central.reach").alias("reach_c"), F.col("central.group").alias("group_c")), f"{name}-tokens")
    return tokens, materialize(join_counted(postings, tokens.select("token", "held"), "token", "held").drop("held"), name)


def _verified(pairs: DataFrame, corpus: _Corpus) -> DataFrame:
    """Of candidate pairs ``a, b`` of classes the similar ones with ``shared``: by longer prefixes and bitmaps, then by whole sets."""
    spark = pairs.sparkSession
    side = lambda c: corpus.profiles.select(F.col("class").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "l", "tokens", "bitmap")])

    def screen(batches):
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                n, m, l_a, l_b = (batch.column(c)[k].as_py() for c in ("n_a", "n_b", "l_a", "l_b"))
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in ("tokens_a", "tokens_b"))
                keep.append(common(x, y) >= min(l_a, l_b) and may_be_similar(batch.column("bitmap_a")[k].as_buffer(), n, batch.column("bitmap_b")[k].as_buffer(), m))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    likely = materialize(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(screen, "a long, b long"), "pairs")
    ids = likely.select(F.col("a").alias("class")).unionByName(likely.select(F.col("b").alias("class")))
    wanted, flags = spark.sparkContext.broadcast(bitmap(ids)), corpus.flags

    def pick(batches):
        for batch in batches:
            batch = _fresh(batch, flags).select(["class", "shingles"])
            yield batch.filter(pa.array(hits(wanted.value, batch.column(0).to_numpy().view(np.uint64))))

    held = materialize(corpus.sets.mapInArrow(pick, "class long, shingles binary"), "wanted")
    wanted.unpersist()

    def decide(batches):
        for batch in batches:
            shared, keep = [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared.append(common(x, y))
                keep.append(similar(shared[-1], len(x), len(y)))
            keep = pa.array(keep, pa.bool_())
            columns = [batch.column("a"), batch.column("b"), pa.array(shared, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["a", "b", "shared"])

    with_a = likely.join(held.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a")
    return with_a.join(held.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(decide, "a long, b long, shared long")


def _across(postings: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of classes in different clusters whose first shared shingle may be the posting's, each pair once."""
    side = lambda df, c: df.select("token", *[F.col(x).alias(f"{x}_{c}") for x in df.columns if x != "token"])
    fits = "n_a <= reach_b and n_b <= reach_a"
    slim = postings.select("token", "cluster", "class", "n", "reach")
    groups = slim.groupBy("token", "cluster").agg(F.min("n").alias("n"), F.max("reach").alias("reach"))
    two = side(groups, "a").join(side(groups, "b"), "token").where("cluster_a < cluster_b").where(fits).select("token", "cluster_a", "cluster_b")
    pairs = two.join(side(slim, "a"), ["token", "cluster_a"]).join(side(slim, "b"), ["token", "cluster_b"]).where(fits)
    return pairs.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()


def _stars(tokens: DataFrame, postings: DataFrame) -> DataFrame:
    """One pair ``a, b`` for each class that isn't in the cluster of a central class: with the one it shares most tokens with."""
    near = join_counted(postings, tokens, "token", "held").where("cluster <> group_c and n <= reach_c and n_c <= reach")
    shared = near.groupBy("class", "centre").agg(F.count(F.lit(1)).alias("shared"))
    best = shared.groupBy("class").agg(F.max_by("centre", F.struct("shared", "centre")).alias("centre"))
    return best.select(F.least("class", "centre").alias("a"), F.greatest("class", "centre").alias("b")).distinct()


def _clusters(corpus: _Corpus) -> DataFrame:
    """``node, component`` of all classes that are linked with another one; components are those of all links."""
    tokens, postings, found, tried = corpus.tokens, corpus.postings, None, None
    for _ in range(ROUNDS):
        pairs = _stars(tokens, postings)
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "stars")
        if pairs.isEmpty():
            break
        links = materialize(_verified(pairs, corpus).select("a", "b"), "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        if links.isEmpty():
            break
        found = links if found is None else found.unionByName(links)
        clusters = components(found)
        placed = postings.drop("cluster").join(clusters, postings["class"] == clusters["node"], "left").select("token", "class", "n", "own", "reach", F.coalesce("component", "class").alias("cluster"))
        tokens, postings = _shared(placed, "postings", "cluster")
    rest = _across(postings)
    rest = materialize(rest if tried is None else rest.join(tried, ["a", "b"], "left_anti"), "across")
    links = rest if rest.isEmpty() else materialize(_verified(rest, corpus).select("a", "b"), "links")
    return components(links if found is None else found.unionByName(links))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, class_id`` of each row; equal class_id means equal sets."""
    corpus = _Corpus(docs, id_col, text_col)
    whole = _clusters(corpus)
    least_ids = corpus.least.join(whole, corpus.least["class"] == whole["node"], "left").select("class", F.coalesce("component", "class").alias("root"), "least_id", F.col("component").isNotNull().alias("linked"))
    roots = least_ids.where("linked").groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = least_ids.join(roots, "root", "left").select("class", F.coalesce("component_id", "least_id").alias("component_id"), F.col("least_id").alias("class_id"))
    return corpus.rows.join(named, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id")
    )


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The whole join, as pairs of classes and membership.

    First ``class_a, class_b, shared, n_a, n_b``: every pair of different sets that are similar, each once. Then ``doc_id,
    n_shingles, class, class_size, n_links`` of each row: rows of equal class have equal sets (and link with each other), and
    n_links is the number of other rows that the row links with, equal sets included. Class is null for empty sets.
    """
    corpus = _Corpus(docs, id_col, text_col)
    found = materialize(_verified(materialize(_across(corpus.postings), "across"), corpus), "links")
    sizes = materialize(corpus.rows.where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("class_size"), F.first("n").alias("n")), "sizes")
    size = lambda c: sizes.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("class_size").alias(f"size_{c}"))
    pairs = materialize(found.join(size("a"), "a").join(size("b"), "b"), "pairs")
    both = pairs.select(F.col("a").alias("class"), F.col("size_b").alias("more")).unionByName(pairs.select(F.col("b").alias("class"), F.col("size_a").alias("more")))
    linked = sizes.join(both.groupBy("class").agg(F.sum("more").alias("more")), "class", "left").select("class", "class_size", (F.coalesce("more", F.lit(0)) + F.col("class_size") - 1).alias("n_links"))
    rows = corpus.rows.join(linked, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), "class", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return pairs.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "shared", "n_a", "n_b"), rows


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with all their columns: of each component the row with the smallest doc_id; rows with a null id stay."""
    result = near_duplicates(docs, id_col, text_col)
    return without_ids(docs, result.where("doc_id <> component_id").select("doc_id"), id_col)


def oracle(table: str = "documents") -> str:
    """doc_id, n_shingles, component_id and class_id as DuckDB SQL (pairs by a plain join, so for small tables)."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({low}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table}),
        s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k : k + 4], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
        c AS (SELECT s, min(doc_id) AS class_id FROM s WHERE len(s) > 0 GROUP BY s),
        u AS (SELECT class_id, len(s) AS n, unnest(s) AS g FROM c),
        p AS (SELECT a.class_id AS a, b.class_id AS b FROM u a JOIN u b ON a.g = b.g AND a.class_id <> b.class_id
            GROUP BY a.class_id, b.class_id HAVING 100 * count(*) >= {PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))),
        r AS (SELECT class_id AS a, class_id AS b FROM c UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
        m AS (SELECT a AS class_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, coalesce(c.class_id, s.doc_id) AS class_id
        FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN m ON c.class_id = m.class_id"""
