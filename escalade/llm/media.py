"""Media columns in archives behind a custom Spark data source.

Payloads (bytes, padded with zero bytes to a positive multiple of 64) are stored as grey PNG images 64 samples wide, 8 bits
each, as members of archive files in a directory. An archive is its members one after the other, then an index (per member:
offset, stored size, crc32, id, whether the id is null, unpadded size), then the index's offset and size and the
magic `MAR1`.

Writing (`format("media_archive")`): each task writes archives under names of its own; a manifest of the write that lists
the archives of its successful tasks is written at commit, and readers see the archives of all manifests. A second
write to a folder thus adds to it.

Reading plans byte ranges of PARTITION_BYTES over the archives from their sizes alone; a task reads the index of its archive
and streams the members that start in its range as Arrow batches. A member that cannot be read, or whose crc32
differs, is read again at its own offset, up to ATTEMPTS times, without the others. So is an archive's index.

Paths are URIs of any file system that pyarrow knows (file, hdfs, s3, gs).

Defined results: null counts as empty (64 zero bytes); null ids stay null; repeated rows are stored each; an empty
table gives a manifest without archives and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import fresh_path

FORMAT = "media_archive"
MAGIC = b"MAR1"
WIDTH = 64
LEVEL = 1
ARCHIVE_BYTES = 64 << 20
PARTITION_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 4
MANIFEST = "_MANIFEST"
_INDEX = np.dtype([("offset", "<u8"), ("size", "<u8"), ("crc", "<u4"), ("id", "<i8"), ("null", "u1"), ("n_bytes", "<u8")])
SCHEMA = "doc_id long, n_bytes long, archive string, member_offset long, media binary"


def padded(data: bytes) -> bytes:
    return data + bytes(WIDTH - len(data) % WIDTH if len(data) % WIDTH or not data else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Grey image of the payload, one sample a byte; the same payload always gives the same bytes."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(lines), WIDTH + 1), np.uint8)
    raw[:, 1:] = lines
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """Samples of a grey 8-bit image without filters, in order."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, width, height = 8, [], 0, 0
    while at < len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", data, at + 8)
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += size + 12
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("filtered lines")
    return raw[:, 1:].reshape(-1)


def features(samples: np.ndarray) -> str:
    """Mean, deviation, entropy in bits and mean absolute step of the samples."""
    p = np.bincount(samples, minlength=256) / len(samples)
    values = np.arange(256)
    mean = float(p @ values)
    deviation = float(np.sqrt(max(p @ (values - mean) ** 2, 0.0)))
    some = p[p > 0]
    step = float(np.abs(np.diff(samples.astype(np.int16))).mean())
    return f"mean={mean:.4f};std={deviation:.4f};entropy={float(-(some * np.log2(some)).sum()):.4f};step={step:.4f}"


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class MediaArchive(DataSource):
    """Option path: the archive directory."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema: object, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("archive_bytes", ARCHIVE_BYTES)))


@dataclass
class Archives(WriterCommitMessage):
    names: list[str]


@dataclass
class ByteRange(InputPartition):
    archive: str
    size: int
    start: int
    end: int


class ArchiveWriter(DataSourceArrowWriter):
    """Rows (doc_id, text bytes) to archives."""

    def __init__(self, path: str, archive_bytes: int):
        self.path, self.archive_bytes = path, archive_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        fs, root = _file_system(self.path)
        fs.create_dir(root, recursive=True)
        names: list[str] = []
        out, index, at = None, [], 0

        def close() -> None:
            body = np.array(index, dtype=_INDEX).tobytes()
            out.write(body + struct.pack("<QQ", at, len(body)) + MAGIC)
            out.close()

        for b in iterator:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.mar")
                    out, index, at = fs.open_output_stream(f"{root}/{names[-1]}"), [], 0
                t = t or b""
                image = to_png(padded(t))
                out.write(image)
                index.append((at, len(image), zlib.crc32(image), i or 0, i is None, len(t)))
                at += len(image)
                if at >= self.archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        return Archives(names)

    def commit(self, messages: list[Archives | None]) -> None:
        fs, root = _file_system(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages: list[Archives | None]) -> None:
        fs, root = _file_system(self.path)
        for m in messages:
            for n in m.names if m else ():
                fs.delete_file(f"{root}/{n}")


def again(what: str, read: Callable[[], bytes], whole: Callable[[bytes], bool], attempts: int = ATTEMPTS) -> bytes:
    """What read() gives, asked for up to `attempts` times until it is whole."""
    problem = ""
    for k in range(attempts):
        try:
            if whole(data := read()):
                return data
            problem = "it is not whole"
        except OSError as e:
            problem = str(e)
        time.sleep(0.05 * 2**k if k < attempts - 1 else 0)
    raise OSError(f"{what}: {problem}")


def _stretch(fs: pafs.FileSystem, path: str, offset: int, size: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(size, offset)


def read_member(fs: pafs.FileSystem, path: str, offset: int, size: int, crc: int, attempts: int = ATTEMPTS) -> bytes:
    """A member by its offset; opened anew for each attempt."""
    return again(f"{path}, member at {offset}", lambda: _stretch(fs, path, offset, size), lambda data: zlib.crc32(data) == crc, attempts)


def read_index(fs: pafs.FileSystem, path: str, archive_size: int) -> np.ndarray:
    end = again(f"{path}, its end", lambda: _stretch(fs, path, archive_size - 20, 20), lambda data: data[16:] == MAGIC)
    at, length = struct.unpack_from("<QQ", end)
    return np.frombuffer(again(f"{path}, its index", lambda: _stretch(fs, path, at, length), lambda data: len(data) == length), _INDEX)


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes = path, partition_bytes

    def partitions(self) -> list[ByteRange]:
        fs, root = _file_system(self.path)
        names: list[str] = []
        for i in sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda i: i.base_name):
            if i.base_name.startswith(MANIFEST):
                with fs.open_input_stream(i.path) as f:
                    names += json.loads(f.read())
        sizes = [(i.base_name, i.size) for i in fs.get_file_info([f"{root}/{n}" for n in names])] if names else []
        plan = [ByteRange(n, size, at, min(at + self.partition_bytes, size)) for n, size in sizes for at in range(0, size, self.partition_bytes)]
        return plan or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, root = _file_system(self.path)
        path = f"{root}/{partition.archive}"
        index = read_index(fs, path, partition.size)
        with fs.open_input_file(path) as f:
            own = index[(index["offset"] >= partition.start) & (index["offset"] < partition.end)]
            rows: list[tuple] = []
            size = 0
            for m in own.tolist():
                offset, stored, crc, doc, null, n_bytes = m
                try:
                    data = f.read_at(stored, offset)
                    whole = zlib.crc32(data) == crc
                except OSError:
                    whole = False
                if not whole:
                    data = read_member(fs, path, offset, stored, crc)
                rows.append((None if null else doc, n_bytes, partition.archive, offset, data))
                size += stored
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "n_bytes", "archive", "member_offset", "media"])


def write_archives(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    docs.sparkSession.dataSource.register(MediaArchive)
    docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("payload")).write.format(FORMAT).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format(FORMAT).option("partition_bytes", partition_bytes).load(path)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for media in b.column("media").to_pylist():
            samples = from_png(media)
            payload = samples.tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def described(media: DataFrame) -> DataFrame:
    """Digests and features of the stored members."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_described, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    path = fresh_path(docs.sparkSession, "media")
    write_archives(docs, path, doc_id, text)
    return described(read_archives(docs.sparkSession, path))
