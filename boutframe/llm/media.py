"""Media columns over archive directories, through a custom Spark data source.

``media_archive`` is a Python data source. Its writer puts each task's members into one tar file of greyscale PNG images
(192 samples a row, so the stored form is lossless) with a sidecar of member offsets. Each write commits a manifest of its
own, so appends add up; an overwrite then removes the older manifests and their archives. Its reader plans byte ranges over
the archives from their sizes alone: a range owns the members whose headers start inside it, found by binary search in the
sidecar (or by walking the headers where a tar has none). Payloads stream in Arrow batches of
``batch_bytes``. A member is read by its own offset; a failed or damaged read of one member is repeated ``retries`` times
with the archive opened anew, without touching the others, and then fails the task with the path and offset. Reading checks
a member by the checksums of its header and chunks and leaves its pixels packed; they are decoded once, by :func:`measure`.

Archives live below the shared folder; any file system that ``pyarrow.fs`` opens by URI can hold them.

Cases: a null text counts as empty; the payload of an empty text is 192 spaces; equal texts give equal stored bytes and
features (the image holds nothing but the payload, ids are in member names); a null doc_id is kept as null; repeated rows
are stored each; empty tables and empty partitions give archives without members and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from boutframe.session import scratch_path, ship

ROW = 192
RANGE_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
RETRIES = 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
MEMBERS = "archive string, offset long, name string, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: str | None) -> bytes:
    """UTF-8 with spaces up to a positive multiple of 192 bytes."""
    data = (text or "").encode()
    return data + b" " * (-len(data) % ROW or (0 if data else ROW))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit greyscale image of 192 samples a row; the payload is its samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks_of(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and content of each chunk of an image, whose checksums are compared."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, kind = 8, b""
    while at < len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        content = data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + content):
            raise ValueError(f"damaged {kind!r} chunk")
        yield kind, content
        at += 12 + size
    if kind != b"IEND":
        raise ValueError("the image is cut short")


def from_png(data: bytes) -> np.ndarray:
    """The samples of an image that :func:`to_png` made, rows by columns; checks every chunk's CRC."""
    body, shape = [], None
    for kind, content in chunks_of(data):
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", content)
            if (width, depth, colour) != (ROW, 8, 0):
                raise ValueError("not 8-bit grey samples of the expected width")
            shape = (height, width + 1)
        elif kind == b"IDAT":
            body.append(content)
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not supported")
    return lines[:, 1:]


def features_of(samples: np.ndarray) -> str:
    """Mean, standard deviation and entropy of the samples, and a 64-bit average hash of an 8 x 8 thumbnail."""
    counts = np.bincount(samples.reshape(-1), minlength=256)
    share = counts[counts > 0] / samples.size
    levels = np.arange(256)
    mean = float(counts @ levels) / samples.size
    sd = max(0.0, float(counts @ (levels * levels)) / samples.size - mean * mean) ** 0.5
    bands = samples.reshape(len(samples), 8, ROW // 8).sum(2, dtype=np.int64)
    edges = np.arange(9) * len(samples) // 8
    sums = np.vstack([np.zeros((1, 8), np.int64), np.cumsum(bands, 0)])
    low = np.minimum(edges[:-1], len(samples) - 1)
    high = np.maximum(edges[1:], low + 1)
    thumb = (sums[high] - sums[low]) / ((high - low)[:, None] * (ROW // 8))
    bits = "".join("1" if x else "0" for x in (thumb >= thumb.mean()).reshape(-1))
    return f"mean={mean:.4f};sd={sd:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};ahash={int(bits, 2):016x}"


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    archive: str
    members: int
    size: int


class _Writer(DataSourceArrowWriter):
    """Rows ``name string, payload binary`` to one archive a task."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _open_fs(self.path)
        fs.create_dir(root, recursive=True)
        archive, offsets, at = f"part-{uuid.uuid4().hex}.tar", [], 0
        with fs.open_output_stream(f"{root}/{archive}") as out:
            for batch in iterator:
                for name, payload in zip(batch.column(0), batch.column(1), strict=True):
                    data = to_png(payload.as_buffer().to_pybytes())
                    info = tarfile.TarInfo(name.as_py())
                    info.size = len(data)
                    block = info.tobuf(tarfile.USTAR_FORMAT) + data + b"\0" * (-len(data) % tarfile.BLOCKSIZE)
                    out.write(block)
                    offsets.append(at)
                    at += len(block)
            out.write(b"\0" * (2 * tarfile.BLOCKSIZE))
        with fs.open_output_stream(f"{root}/{archive}.idx") as out:
            out.write(np.array(offsets, "<i8").tobytes())
        return _Written(archive, len(offsets), at)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Only archives named in a manifest count, so what a lost or repeated task left behind is never read."""
        fs, root = _open_fs(self.path)
        done = [{"archive": m.archive, "members": m.members, "bytes": m.size} for m in messages if m]
        fs.create_dir(root, recursive=True)
        older = _manifests(fs, root) if self.overwrite else []
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(done).encode())
        for manifest in older:
            entries = _entries(fs, manifest)
            fs.delete_file(manifest)
            _remove(fs, root, [x["archive"] for x in entries])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open_fs(self.path)
        _remove(fs, root, [m.archive for m in messages if m])


def _manifests(fs: pafs.FileSystem, root: str) -> list[str]:
    files = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in files if re.fullmatch(r"_manifest.*\.json", f.base_name))


def _entries(fs: pafs.FileSystem, manifest: str) -> list[dict]:
    with fs.open_input_stream(manifest) as file:
        return json.loads(file.read())


def _remove(fs: pafs.FileSystem, root: str, archives: list[str]) -> None:
    for name in archives:
        for path in (f"{root}/{name}", f"{root}/{name}.idx"):
            if fs.get_file_info(path).type == pafs.FileType.File:
                fs.delete_file(path)


@dataclass
class ByteRange(InputPartition):
    """The members of an archive whose headers start at ``start`` or later and before ``end``."""

    archive: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path = path
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batch_bytes", BATCH_BYTES))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[InputPartition]:
        fs, root = _open_fs(self.path)
        manifests = _manifests(fs, root)
        if manifests:
            found = [(x["archive"], x["bytes"]) for m in manifests for x in _entries(fs, m) if x["members"]]
        else:
            files = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            found = sorted((f.path.removeprefix(root).lstrip("/"), f.size) for f in files if f.path.endswith(".tar"))
        return [ByteRange(name, a, min(a + self.range_bytes, size)) for name, size in found for a in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        fs, root = _open_fs(self.path)
        rows, size = [], 0
        for offset in self._offsets(fs, f"{root}/{partition.archive}", partition) if partition.archive else ():
            name, data = self._member(fs, f"{root}/{partition.archive}", offset)
            rows.append((partition.archive, offset, name, data))
            size += len(data)
            if size >= self.batch_bytes:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "offset", "name", "media"])

    def _offsets(self, fs: pafs.FileSystem, path: str, part: ByteRange) -> Iterator[int]:
        if fs.get_file_info(f"{path}.idx").type == pafs.FileType.File:
            with fs.open_input_file(f"{path}.idx") as file:
                first, last = (_search(file, at) for at in (part.start, part.end))
                file.seek(8 * first)
                yield from np.frombuffer(file.read(8 * (last - first)), "<i8").tolist()
            return
        at = 0
        with fs.open_input_file(path) as file:
            while at < part.end:
                file.seek(at)
                head = file.read(tarfile.BLOCKSIZE)
                if len(head) < tarfile.BLOCKSIZE or not head.strip(b"\0"):
                    return
                info = tarfile.TarInfo.frombuf(head, "utf-8", "strict")
                if at >= part.start and info.isreg():
                    yield at
                at += tarfile.BLOCKSIZE + -(-info.size // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE

    def _member(self, fs: pafs.FileSystem, path: str, offset: int) -> tuple[str, bytes]:
        for attempt in range(self.retries + 1):
            try:
                if attempt or getattr(self, "_open_path", None) != path:
                    self._file, self._open_path = fs.open_input_file(path), path
                self._file.seek(offset)
                info = tarfile.TarInfo.frombuf(self._file.read(tarfile.BLOCKSIZE), "utf-8", "strict")
                data = self._file.read(info.size)
                if len(data) != info.size:
                    raise OSError("short read")
                if info.name.endswith(".png"):
                    for _ in chunks_of(data):
                        pass
                return info.name, data
            except (OSError, ValueError, tarfile.HeaderError, zlib.error, struct.error) as error:
                if attempt == self.retries:
                    raise OSError(f"{path}: the member at offset {offset} can't be read: {error}") from error
                time.sleep(0.05 * 2**attempt)
        raise AssertionError


def _search(file: pa.NativeFile, value: int) -> int:
    """How many of a sidecar's ascending offsets are below a value; reads as many of them as a binary search takes."""
    low, high = 0, file.size() // 8
    while low < high:
        middle = (low + high) // 2
        file.seek(8 * middle)
        if struct.unpack("<q", file.read(8))[0] < value:
            low = middle + 1
        else:
            high = middle
    return low


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(directory)`` gives archive, offset, name, media of each member."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(MediaArchive)


def store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", mode: str = "append") -> None:
    """Write each text as a PNG member ``<doc_id>.<bytes>.png`` of the archives in ``path``; ``mode`` is append or overwrite."""
    register(docs.sparkSession)

    def members(batches):
        for batch in batches:
            names, payloads = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(f"{'null' if doc is None else doc}.{len((text or '').encode())}.png")
                payloads.append(payload_of(text))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(payloads, pa.binary())], names=["name", "payload"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(members, "name string, payload binary")
    rows.write.format("media_archive").mode(mode).save(path)


def measure(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read the archives in ``path`` back and compute each member's digests and features from the stored bytes."""
    register(spark)

    def run(batches):
        for batch in batches:
            rows = []
            for name, media in zip(batch.column("name").to_pylist(), batch.column("media").to_pylist(), strict=True):
                doc, n, _ = name.split(".")
                samples = from_png(media)
                payload = samples.tobytes()
                rows.append((None if doc == "null" else int(doc), int(n), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features_of(samples)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = zip(*rows, strict=True) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return spark.read.format("media_archive").options(**{k: str(v) for k, v in options.items()}).load(path).mapInArrow(run, FEATURES)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as media below the shared folder, read the stored bytes back, and return the features."""
    path = scratch_path(docs.sparkSession, "media")
    store(docs, path, id_col, text_col)
    return measure(docs.sparkSession, path)
