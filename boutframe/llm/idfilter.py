"""Dropping rows by id without moving the rows that stay, and joins with counted keys.

A bitmap of fixed size (``2**bits`` bits, so its broadcast is bounded) holds the hashes of the ids to drop. Rows that miss
it stay where they are; rows that hit it, the dropped ones and few others, meet the exact ids in a join. A full bitmap
would only send more rows to the join.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutframe.llm.words import mix
from boutframe.session import ship

BITS = 26
HOT = 1000


def spare(columns: list[str], name: str) -> str:
    """A column name that a table doesn't have yet, in either case of letters."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def join_counted(rows: DataFrame, counted: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``rows`` with a table of one row a key whose column ``count`` is the number of the key's rows.

    Keys with more than a ``1 / HOT``-th of all counted rows, fewer than ``HOT`` whatever the input, are broadcast, so their
    rows are not moved; all other keys are joined by a shuffle in which none of them is large. ``rows`` is read twice.
    """
    total = counted.agg(F.sum(count)).first()[0] or 0
    hot, cold = counted.where(F.col(count) * HOT > total), counted.where(F.col(count) * HOT <= total)
    spread = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(spread)


class Packed:
    """An array of bytes that travels compressed, so that a sparse one takes little of a broadcast and of its copies on disk."""

    def __init__(self, array: np.ndarray):
        self.array = array

    def __getstate__(self) -> bytes:
        return zlib.compress(self.array.tobytes(), 1)

    def __setstate__(self, data: bytes) -> None:
        self.array = np.frombuffer(zlib.decompress(data), np.uint8)


def bitmap(hashes: DataFrame, bits: int = BITS) -> Packed:
    """Bytes in which the bit of each row's 64-bit number (its one column) is set: the number's highest bits count."""
    (name,) = hashes.columns
    slot = F.shiftrightunsigned(name, 64 - bits)
    rows = hashes.select(F.shiftright(slot, 16).alias("chunk"), slot.bitwiseAND(F.lit(0xFFFF)).cast("int").alias("low")).groupBy("chunk").agg(F.collect_set("low").alias("low"))

    def pack(batches):
        for batch in batches:
            out = []
            for low in batch.column("low"):
                flags = np.zeros(1 << 16, np.uint8)
                flags[low.values.to_numpy()] = 1
                out.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("chunk").cast(pa.int64()), pa.array(out, pa.binary())], names=["chunk", "bytes"])

    whole = np.zeros((1 << (bits - 16), 8192), np.uint8)
    for row in rows.mapInArrow(pack, "chunk long, bytes binary").collect():  # 2**(bits-16) rows of 8 KiB at most
        whole[row["chunk"]] = np.frombuffer(row["bytes"], np.uint8)
    return Packed(whole.reshape(-1))


def hits(flags: Packed, numbers: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether each unsigned 64-bit number's bit is set."""
    slot = (numbers >> np.uint64(64 - bits)).astype(np.int64)
    return (flags.array[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def without_ids(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in the one column of ``dropped``; rows with a null id stay."""
    spark = docs.sparkSession
    ship(spark)
    gone = spare(docs.columns, "gone")
    ids = dropped.select(F.col(dropped.columns[0]).cast("long").alias(gone)).where(F.col(gone).isNotNull()).distinct()

    def scramble(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], names=["h"])

    flags = spark.sparkContext.broadcast(bitmap(ids.mapInArrow(scramble, "h long")))
    place = docs.columns.index(id_col)

    def pick(wanted: bool):
        def run(batches):
            for batch in batches:
                ids = batch.column(place).cast(pa.int64())
                found = hits(flags.value, mix(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
                found &= ids.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(found == wanted))

        return run

    plain, doubtful = docs.mapInArrow(pick(False), docs.schema), docs.mapInArrow(pick(True), docs.schema)
    return plain.unionAll(doubtful.join(ids, F.col(id_col) == F.col(gone), "left_anti"))
