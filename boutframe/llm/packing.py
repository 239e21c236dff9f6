"""Best-two-fit packing of token sequences.

Pieces of one length are interchangeable, so the packing is decided on the histogram of lengths (at most ``capacity``
numbers, whatever the input's size): a bin is filled greedily, the longest piece that fits first; then, while a gap is
left, its smallest piece gives way to two unpacked pieces whose lengths together fill the expanded gap more tightly. Every
swap spends a small piece that later bins may need, so how large a gap has to be for one is tried: the histogram is planned for
each of ``GAPS`` (shares of the capacity) and the plan with the fewest bins is taken, the first of equal ones. A
bin pattern repeats as often as the histogram allows. Pieces then take their places by rank among the pieces of their
length: a running count inside each task, plus the counts of the tasks before it, so no group is gathered anywhere.

The pieces are written to the shared folder once tokenised: a lost executor costs no second numbering of the pieces.

Cases: a null text counts as empty and is the end id alone; only documents longer than the capacity are cut, with the
shorter piece first; repeated rows are packed each; a null doc_id passes through; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutframe.llm.bpe import default_vocabulary, encoder
from boutframe.session import materialize, ship

CAPACITY = 1024
END_ID = 2
#: The smallest gaps that are worth a swap, as parts of the capacity; the first means any gap.
GAPS = (0, 1 / 256, 1 / 64, 1 / 16)
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-two-fit on a histogram of lengths: (lengths in a bin, number of such bins), the smallest of the plans of ``GAPS``."""
    plans = [plan_with(histogram, capacity, max(1, round(gap * capacity))) for gap in GAPS]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def plan_with(histogram: dict[int, int], capacity: int, least_gap: int) -> list[tuple[tuple[int, ...], int]]:
    """A plan that swaps in bins with a gap of ``least_gap`` or more."""
    left = {length: n for length, n in histogram.items() if n > 0}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError("a length is not within the capacity")
    plan = []
    while left:
        sizes = sorted(left)
        used: Counter[int] = Counter()

        def longest(limit: int) -> int | None:
            at = bisect_right(sizes, limit) - 1
            while at >= 0 and used[sizes[at]] >= left[sizes[at]]:
                at -= 1
            return sizes[at] if at >= 0 else None

        gap = capacity
        while gap and (length := longest(gap)):
            used[length] += 1
            gap -= length
        while gap >= least_gap and (pair := _tighter_pair(sizes, left, used, min(+used), gap)):
            smallest = min(+used)
            used[smallest] -= 1
            used.update(pair)
            gap += smallest - sum(pair)
        pattern = +used
        times = min(left[length] // n for length, n in pattern.items())
        plan.append((tuple(sorted(pattern.elements(), reverse=True)), times))
        for length, n in pattern.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return plan


def _tighter_pair(sizes: list[int], left: dict[int, int], used: Counter, smallest: int, gap: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum above ``smallest`` and within the gap that it leaves."""
    room, best, found = smallest + gap, smallest, None
    free = [s for s in sizes[: bisect_right(sizes, room)] if left[s] > used[s]]
    low, high = 0, len(free) - 1
    while low <= high:
        total = free[low] + free[high]
        if total > room:
            high -= 1
            continue
        if total > best and (low != high or left[free[low]] - used[free[low]] >= 2):
            best, found = total, (free[high], free[low])
            if best == room:
                break
        low += 1
    return found


def pieces_of(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised pieces: doc_id, piece, start, length, ids_crc32, and the task with the rank among its equal lengths."""
    ship(docs.sparkSession)
    path, end = vocabulary or default_vocabulary(), end_id

    def run(batches):
        coder, task, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        names = [x.split()[0] for x in PIECE.split(", ")]
        for batch in batches:
            at = 0
            for ids, counts in coder.groups(batch.column(1).to_pylist()):
                docs_here = batch.column(0).slice(at, len(counts)).to_pylist()
                at += len(counts)
                data = memoryview(np.insert(ids, np.cumsum(counts), end).astype("<u4").tobytes())
                rows, first = [], 0
                for doc, n in zip(docs_here, (counts + 1).tolist(), strict=True):
                    start = 0
                    for piece, stop in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                        length = stop - start
                        rows.append((doc, piece, start, length, zlib.crc32(data[4 * (first + start) : 4 * (first + stop)]), task, seen[length]))
                        seen[length] += 1
                        start = stop
                    first += n
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names=names)
        coder.forget()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECE)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    pieces = materialize(pieces_of(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {row["length"]: row["n"] for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    starts, firsts, offsets, taken, sequence = [], [], [], Counter(), 0
    for pattern, times in plan_bins(histogram, capacity):
        offset = 0
        for length in pattern:
            starts.append((length, taken[length]))
            firsts.append(sequence)
            offsets.append(offset)
            taken[length] += times
            offset += length
        sequence += times
    order = sorted(range(len(starts)), key=starts.__getitem__)
    key = np.array([starts[k][0] << 48 | starts[k][1] for k in order], np.int64)
    rank0 = np.array([starts[k][1] for k in order], np.int64)
    first, place = np.array([firsts[k] for k in order], np.int64), np.array([offsets[k] for k in order], np.int64)

    def places(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, length << 48 | rank, "right") - 1
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(first[at] + rank - rank0[at]), pa.array(place[at])], names=[x.split()[0] for x in PLACED.split(", ")])

    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(base, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(places, PLACED)
