"""Second-order gradient boosting over histograms, with a learned side for missing values at every split.

Features are cut into at most ``BINS`` bins by approximate quantiles, once; rows are kept as bytes of bins with their margin.
For each level of a tree, every task adds up gradients, second derivatives and counts by node, feature and bin of its rows, a
row a node and feature, and one small shuffle adds up those of the tasks; the driver sees a histogram of ``nodes x features x bins``, never rows. Both sides are
tried for the missing values of each split and the better one is kept, as is the side without any where nothing was missing.
Leaves follow from the last level's histogram. Every ``KEEP`` trees the rows' margins are written anew, so that a pass looks
at the last few trees only; the table before is removed.

Gradients are rounded to 2^-20 and added as integers, so a model doesn't depend on how rows are spread over tasks. A row takes
part in a tree by a hash of its key and the tree's number, a column by a seeded draw.

Cases: null and NaN are missing; a feature that is always missing or has one value is never split on; rows without a label are
left out; without rows or with one label only there are no trees and everything scores the base rate; scoring keeps all columns.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe.session import drop_scratch, materialize, ship

BINS, KEEP, UNIT = 254, 20, 1 << 20
MISSING = 255


@dataclass
class Tree:
    """Nodes by number; ``feature`` -1 marks a leaf. A value up to ``cut`` (a bin up to ``bin``) goes left, a missing one to ``left_default``'s side."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left_default: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [0])
    weight: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin_: int, cut: float, left_default: bool, weights: tuple[float, float]) -> None:
        self.feature[node], self.bin[node], self.cut[node], self.left_default[node], self.left[node] = feature, bin_, cut, left_default, len(self.feature)
        for weight in weights:
            for values, value in ((self.feature, -1), (self.bin, 0), (self.cut, 0.0), (self.left_default, True), (self.left, 0), (self.weight, weight)):
                values.append(value)

    def nodes(self, goes_left: Callable[[int], np.ndarray]) -> np.ndarray:
        """The leaf of each row (one number for all in a tree of one leaf). ``goes_left`` gives a node's decision for all rows."""

        def below(node: int) -> np.ndarray:
            if self.feature[node] < 0:
                return np.uint16(node)
            return np.where(goes_left(node), below(self.left[node]), below(self.left[node] + 1))

        return below(0)

    def nodes_of_bins(self, bins: np.ndarray) -> np.ndarray:
        """:meth:`nodes` of ``bins`` (features x rows), by a table of 256 decisions a node."""

        def goes_left(node: int) -> np.ndarray:
            sides = np.arange(256) <= self.bin[node]
            sides[MISSING] = self.left_default[node]
            return sides[bins[self.feature[node]]]

        return self.nodes(goes_left)


@dataclass
class Booster:
    features: list[str]
    base: float
    trees: list[Tree]

    def margins(self, values: np.ndarray) -> np.ndarray:
        columns = np.ascontiguousarray(values.T)
        missing = np.isnan(columns)
        total = np.full(len(values), self.base)
        for tree in self.trees:
            side = lambda k, t=tree: np.where(missing[t.feature[k]], t.left_default[k], columns[t.feature[k]] <= t.cut[k])
            total += np.array(tree.weight)[tree.nodes(side)]
        return total

    def score(self, df: DataFrame, column: str = "p") -> DataFrame:
        """``df`` with the probability of label 1."""
        ship(df.sparkSession)
        inputs = [f"__feature_{k}" for k in range(len(self.features))]
        given = df.withColumns({name: F.col(f).cast("double") for name, f in zip(inputs, self.features, strict=True)}) if inputs else df
        columns, model = df.columns, self

        def run(batches):
            for batch in batches:
                if inputs:
                    values = np.stack([batch.column(name).to_numpy(zero_copy_only=False).astype(np.float64) for name in inputs], 1)
                else:
                    values = np.zeros((batch.num_rows, 0))
                p = 1 / (1 + np.exp(-np.clip(model.margins(values), -700, 700)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(p)], names=[*columns, column])

        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return given.mapInArrow(run, f"{kept}, `{column}` double" if kept else f"`{column}` double")


def cut_points(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """For each feature the upper ends of its bins, but the last: distinct approximate quantiles, from one aggregation."""
    steps = F.array(*[F.lit((k + 1) / bins) for k in range(bins)])
    known = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    row = df.agg(*[F.percentile_approx(known(f), steps, 100 * bins).alias(str(k)) for k, f in enumerate(features)]).first()
    return [np.unique(np.array(q or [], float))[:-1] for q in row]


def _binned(df: DataFrame, features: list[str], label: str, key: str, cuts: list[np.ndarray], base: float) -> DataFrame:
    """``key`` as a hash, ``bins`` (a byte a feature), ``y``, ``margin``."""

    def run(batches):
        for batch in batches:
            out = np.full((batch.num_rows, len(features)), MISSING, np.uint8)
            for k in range(len(features)):
                values = batch.column(k + 2).to_numpy(zero_copy_only=False).astype(np.float64)
                known = ~np.isnan(values)
                out[known, k] = np.searchsorted(cuts[k], values[known], side="left")
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * len(features)
            rows = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([batch.column(0), rows, batch.column(1), pa.array(np.full(batch.num_rows, base))], names=["key", "bins", "y", "margin"])

    chosen = df.where(F.col(label).isNotNull()).select(F.xxhash64(key).alias("key"), F.col(label).cast("double").alias("y"), *[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)])
    return chosen.mapInArrow(run, "key long, bins binary, y double, margin double")


def _taken(keys: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Whether a row takes part in a tree: splitmix64 of its key, the tree and the seed."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (1 + tree + 1000003 * seed)) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**53 < share


class _Rows:
    """What a task computes from batches of binned rows under the trees since the margins were written."""

    def __init__(self, width: int, pending: list[Tree]):
        self.width, self.pending = width, pending

    def read(self, batch) -> tuple[np.ndarray, np.ndarray]:
        """Bins (features x rows) and margins. Bins are taken from Arrow's buffer, as every row has as many."""
        rows = batch.column("bins").cast(pa.large_binary())
        first = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset]
        bins = np.ascontiguousarray(np.frombuffer(rows.buffers()[2], np.uint8, batch.num_rows * self.width, first).reshape(batch.num_rows, self.width).T)
        margin = batch.column("margin").to_numpy(zero_copy_only=False).copy()
        for tree in self.pending:
            margin += np.array(tree.weight)[tree.nodes_of_bins(bins)]
        return bins, margin


def _joined(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows: what is done once a batch, node and column counts for less."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _histogram(rows: DataFrame, width: int, pending: list[Tree], tree: Tree, nodes: list[int], columns: list[int], number: int, share: float, seed: int) -> dict[int, np.ndarray]:
    """For each of ``nodes``: features x bins x (gradient, second derivative, count), in units."""
    reader = _Rows(width, pending)

    def run(batches):
        total = np.zeros((len(nodes), len(columns), 256, 3), np.int64)
        for batch in _joined(batches):
            bins, margin = reader.read(batch)
            p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
            y = batch.column("y").to_numpy(zero_copy_only=False)
            at = np.broadcast_to(tree.nodes_of_bins(bins), batch.num_rows)
            place = np.full(len(tree.feature), -1)
            place[nodes] = np.arange(len(nodes))
            here = place[at]
            chosen = np.flatnonzero((here >= 0) & _taken(batch.column("key").to_numpy(zero_copy_only=False), number, share, seed))
            here, p, y = here[chosen] * 256, p[chosen], y[chosen]
            sums = np.rint((p - y) * UNIT), np.rint(p * (1 - p) * UNIT), None
            for k, c in enumerate(columns):
                slot = here + bins[c][chosen]
                for m, weights in enumerate(sums):
                    total[:, k, :, m] += np.bincount(slot, weights, len(nodes) * 256).astype(np.int64).reshape(len(nodes), 256)
        yield _packed(dict(enumerate(total.reshape(-1, 256, 3))))

    sums: dict[int, np.ndarray] = {}
    for batch in rows.mapInArrow(run, "slot int, sums binary").repartition("slot").mapInArrow(_added, "slot int, sums binary").toArrow().to_batches():  # nodes x features at most
        _add(sums, batch)
    total = np.stack([sums.get(slot, np.zeros((256, 3), np.int64)) for slot in range(len(nodes) * len(columns))])
    return dict(zip(nodes, total.reshape(len(nodes), len(columns), 256, 3), strict=True))


def _packed(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    """A row a node and feature, with its bins' sums as bytes."""
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slot", "sums"])


def _add(sums: dict[int, np.ndarray], batch: pa.RecordBatch) -> None:
    for slot, packed in zip(batch.column("slot").to_pylist(), batch.column("sums").to_pylist(), strict=True):
        sums[slot] = sums.get(slot, 0) + np.frombuffer(packed, np.int64).reshape(256, 3)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        _add(sums, batch)
    yield _packed(sums)


def best_split(hist: np.ndarray, ridge: float, least: float) -> tuple[float, int, int, bool, tuple[float, float]] | None:
    """``gain, column, bin, missing left?, leaf values`` of the best split of a node's histogram; None without a gain."""
    best = None
    for k in range(len(hist)):
        sums, gone = hist[k, :MISSING].astype(float), hist[k, MISSING].astype(float)
        used = np.flatnonzero(sums[:, 2])
        if len(used) == 0:
            continue
        running, whole = np.cumsum(sums, 0), sums.sum(0) + gone
        score = lambda s: s[..., 0] ** 2 / (s[..., 1] + ridge * UNIT)
        for missing_left in (True, False) if gone[2] else (True,):
            left = running[used] + (gone if missing_left else 0)
            right = whole - left
            fit = (left[:, 2] > 0) & (right[:, 2] > 0) & (left[:, 1] >= least * UNIT) & (right[:, 1] >= least * UNIT)
            gain = np.where(fit, score(left) + score(right) - score(whole), -np.inf)
            at = int(gain.argmax())
            if gain[at] > 1e-9 * UNIT and (best is None or gain[at] > best[0]):
                values = tuple(-s[0] / (s[1] + ridge * UNIT) for s in (left[at], right[at]))
                best = (float(gain[at]), k, int(used[at]), missing_left, values)
    return best


def fit(df: DataFrame, features: list[str], label: str = "target", key: str = "fight_id", trees: int = 200, depth: int = 3, rate: float = 0.05, rows: float = 0.85, columns: float = 0.85, ridge: float = 1.0, least: float = 1.0, bins: int = BINS, seed: int = 42) -> Booster:
    """A booster for a label of 0 and 1 (or a boolean). ``rows`` and ``columns``: the shares that take part in a tree."""
    ship(df.sparkSession)
    df = df.withColumn(label, F.col(label).cast("double"))
    share = df.agg(F.avg(label).alias("y")).first()["y"]
    if share is None or not 0 < share < 1 or not features:
        return Booster(features, 0.0 if share is None else 40.0 * (2 * share - 1) if share in (0, 1) else math.log(share / (1 - share)), [])
    base, cuts = math.log(share / (1 - share)), cut_points(df, features, min(bins, BINS))
    table, pending, grown, draw = materialize(_binned(df, features, label, key, cuts, base), "binned"), [], [], random.Random(seed)
    for number in range(trees):
        chosen = sorted(draw.sample(range(len(features)), max(1, round(columns * len(features)))))
        tree, level = Tree(), [0]
        for _ in range(depth):
            hists, following = _histogram(table, len(features), pending, tree, level, chosen, number, rows, seed), []
            for node in level:
                found = best_split(hists[node], ridge, least)
                if found:
                    _, k, bin_, missing_left, values = found
                    feature = chosen[k]
                    cut = float(cuts[feature][bin_]) if bin_ < len(cuts[feature]) else math.inf
                    tree.split(node, feature, bin_, cut, missing_left, tuple(rate * v for v in values))
                    following += [tree.left[node], tree.left[node] + 1]
            level = following
            if not level:
                break
        pending.append(tree)
        grown.append(tree)
        if len(pending) == KEEP and number + 1 < trees:
            later = materialize(_with_margins(table, len(features), pending), "binned")
            drop_scratch(table)
            table, pending = later, []
    drop_scratch(table)
    return Booster(features, base, grown)


def _with_margins(table: DataFrame, width: int, pending: list[Tree]) -> DataFrame:
    reader = _Rows(width, pending)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(reader.read(batch)[1]))

    return table.mapInArrow(run, table.schema)
