"""Runs of words: stretches that repeat themselves, found by probing harmonic grids.

Words are maximal runs of anything but space and the characters 9 to 13, compared as they are. A run is a stretch whose
smallest period is q (words q apart are equal), of at least ``LEAST`` words and ``TIMES`` periods, that no neighbouring word
extends keeping period q.

For each period p up to a quarter of the text, words are compared at the grid points jp and (j+1)p. A run of at least four
periods holds at least three neighbouring grid points whose words equal those one period on, and all words from the first of
them to the third do so too; so grid points are kept only where three in a row are equal, and then where seven words between
are. Over all periods that is a harmonic sum of n log n comparisons, made by slices: for periods up to the square root of n a
slice a period, for longer ones a slice for each j over all periods at once. What is left is extended to both sides by
comparing chunks that double in length. Grid points inside a found run whose period divides p are skipped, for they could only
give that run again; a stretch with period p whose smallest period is shorter is such a run, so runs have their smallest period.

Cases: null and empty texts have no words and no runs; a null doc_id counts as an empty text where ids are hashed; repeated
rows each give a row; a text of one word repeated is one run of period 1; empty tables and empty partitions give no rows; of
the documents only id and text are read. A text's words are numbers of 4 bytes while it is looked at; one text is looked at by
one task, all texts independently.
"""

from __future__ import annotations

import hashlib
import zlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe.session import ship

LEAST, TIMES = 6, 4
CHUNK = 64
ROW = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _first_difference(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items are equal, by chunks that double."""
    at, size, stop = 0, CHUNK, min(len(a), len(b))
    while at < stop:
        same = a[at : min(at + size, stop)] == b[at : min(at + size, stop)]
        if not same.all():
            return at + int(same.argmin())
        at, size = at + size, 2 * size
    return stop


class _Probe:
    """``found``: stretches with their smallest periods; ``covers``: for each period the starts and stops of its long runs, in order."""

    def __init__(self, words: np.ndarray):
        self.w, self.found, self.covers = words, {}, {}

    def solid(self, p, at: np.ndarray) -> np.ndarray:
        """Of grid points ``at`` with three equalities in a row, those with equal words at seven places between, too."""
        keep = np.ones(len(at), bool)
        for k in range(1, 8):
            places = at + 2 * p * k // 8
            keep &= self.w[places] == self.w[places + p]
        return keep

    def fresh(self, p, at: np.ndarray) -> np.ndarray:
        """Grid points that no found run with a period dividing theirs covers."""
        keep = np.ones(len(at), bool)
        for q, (starts, stops) in self.covers.items():
            last = np.searchsorted(starts, at, side="right") - 1  # runs of one period never hold each other, so the last one reaches furthest
            keep &= (last < 0) | (at + p >= stops[last]) | (p % q != 0)
        return keep

    def forget(self, p: int) -> None:
        """Drop runs too short to hold three grid steps of ``p`` or more."""
        for q, (starts, stops) in list(self.covers.items()):
            long = stops - starts > 3 * p
            if not long.all():
                self.covers[q] = starts[long], stops[long]
            if not long.any():
                del self.covers[q]

    def extend(self, p: int, points: list[int]) -> None:
        w, done, new = self.w, -1, []
        for at in points:
            if at < done:
                continue
            right = at + _first_difference(w[at:], w[at + p :])  # the first word that differs from the one a period on
            left = at - _first_difference(w[:at][::-1], w[: at + p][::-1])
            done = right
            if right + p - left >= max(LEAST, TIMES * p) and (left, right + p) not in self.found:
                self.found[left, right + p] = p
                new.append((left, right + p))
        if new:
            self.covers[p] = tuple(np.array(x) for x in zip(*new, strict=True))

    def run(self) -> list[tuple[int, int, int]]:
        w, n = self.w, len(self.w)
        top = n // TIMES
        root = min(top, isqrt(n))
        for p in range(1, root + 1):  # a slice a period
            g = w[::p]
            if len(g) < 4:
                break
            same = g[1:] == g[:-1]
            at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * p
            if at.size and p > 1:
                self.forget(p)
                at = at[self.fresh(p, at)]
                at = at[self.solid(p, at)]
            self.extend(p, at.tolist())
        self.forget(root)
        found_p, found_at = [], []
        for j in range((n - 1) // (root + 1) - 2):  # a slice for each j over all longer periods; (j + 3) p is the last grid point
            last = min(top, (n - 1) // (j + 3))
            count = last - root
            if count <= 0:
                break
            line = lambda k, count=count: w[k * (root + 1) :: k][:count] if k else np.full(count, w[0])
            p = np.flatnonzero(line(j) == line(j + 1)) + root + 1
            if p.size:
                p = p[(w[(j + 1) * p] == w[(j + 2) * p]) & (w[(j + 2) * p] == w[(j + 3) * p])]
            if p.size:
                p = p[self.solid(p, j * p)]
                p = p[self.fresh(p, j * p)]
                found_p.append(p)
                found_at.append(j * p)
        ps, ats = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_p, found_at))
        order = np.lexsort((ats, ps))
        for points in np.split(order, np.flatnonzero(np.diff(ps[order])) + 1):  # by period, the shortest first
            if points.size:
                p = int(ps[points[0]])
                self.forget(p)
                self.extend(p, ats[points][self.fresh(p, ats[points])].tolist())
        return sorted(((start, stop, p) for (start, stop), p in self.found.items()), key=lambda r: (r[0], r[2]))


def runs(words: list) -> list[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` of a list of words, by start, then period."""
    if len(words) < LEAST:
        return []
    known: dict = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
    return [(start, stop - start, p) for start, stop, p in _Probe(numbers).run()]


def collapse(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    keep = np.ones(len(words), bool)
    for start, length, p in found:
        keep[start + p : start + length] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()]


def planted(words: list, doc_id: str) -> list:
    """The words of a document; of a tenth of the ids, with a part that repeats (the query's own test cases)."""
    h = zlib.crc32(doc_id.encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * -(-(n - a) // len(unit)))[: n - a]


def _row(words: list) -> tuple:
    found = runs(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    longest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return len(found), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(words, found))).hexdigest()


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """A row for each document: how many runs, the longest one, digests of all runs and of the text without repeats.

    ``plant`` gives a tenth of the documents a part that repeats, as the query asks for.
    """
    ship(docs.sparkSession)
    names = [c.split()[0] for c in ROW.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches):
        for batch in batches:
            rows = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()
                rows.append((own, *_row(planted(words, "" if own is None else str(own)) if plant else words)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ROW)


def collapse_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every run cut to its first period; words are joined by one space where something was cut, other texts stay."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def cut(text):
        words = (text or "").encode().split()
        found = runs(words)
        return b" ".join(collapse(words, found)).decode() if found else text

    def run(batches):
        for batch in batches:
            yield batch.set_column(at, batch.schema.field(at), pa.array([cut(t.as_py()) for t in batch.column(at)], batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
