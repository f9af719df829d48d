"""Removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

Every byte is removed that a string of `length` bytes covers which starts anywhere else too, in the same document or
another. Strings are judged on the input.

Suffixes that matter. With q = w = length // 2, each string of `length` bytes holds at least w q-grams; the one with the
least hash (the leftmost of equals) is its anchor. Equal strings have the same anchor at the same place, so only
anchors, about one byte in w / 2, are sorted. An anchor's context is the stretch of text in which all strings
lie that it can be the anchor of.

1. Initial buckets: anchors by the hash of their q-gram, counted over all documents. A bucket of one anchor is done:
   none of its strings occurs twice.
2. A bucket all of whose contexts are equal is done as well: refinement sorts on what lies at later offsets, and there
   all its suffixes hold the same bytes as far as any of their strings reaches, so that every pass would leave the bucket
   as it is and its strings occur at each of its anchors. Such buckets, like those of any number of copies, keep
   their first bucket identifier as the last one.
3. Buckets of several contexts are refined, from one row per distinct context (with its count). Large buckets are
   first split over the cluster by the bytes around the anchor (see repeats_of). The others go to a task each, whose q-gram
   buckets are refined by sorting positions on the pair (bucket at the position, bucket at a later offset), the
   bucket identifiers of one pass being the pointers of the next, until they tell strings of `length` bytes apart.
   A string whose final bucket holds more than one occurrence is a repeat.

Positions of repeats go back to their documents, where covered bytes are removed.

Defined results: null counts as empty; texts under `length` bytes lose nothing; repeated rows are copies of each other;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, mix64, partitions, ragged, row_key, saved, text_chunks

LENGTH = 200
#: Bytes that a task hashes or refines at a time.
CHUNK_BYTES = 500_000
#: Parts of a bucket that are refined inside a task; larger buckets are split first.
TASK_PARTS = 64
_RNG = np.random.default_rng(6021)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)])) for b in (_BASE, _INV)]
    return _POWERS[0], _POWERS[1]


class Hashes:
    """Hashes of any substring of a byte array."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the least value in each window of w values, all below 2^40, the leftmost of equals."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, dtype=np.int64)
    mask = np.uint64((1 << 24) - 1)
    # Blocks of windows that fit the cache; the place inside the block breaks ties in the lower bits.
    for at in range(0, n, 1 << 15):
        part = h[at : min(at + (1 << 15), n) + w - 1]
        least = (part << np.uint64(24)) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while 2 * size <= w:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < w:
            least = np.minimum(least[: len(part) - w + 1], least[w - size :])
        out[at : at + len(least)] = (least & mask).astype(np.int64) + at
    return out


def anchors(data: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts that stand one behind the other in data: per anchor its text, its place, hash of its q-gram, and the first and last string start that it is the anchor of; and the hashes."""
    q = length // 2
    hashes = Hashes(data)
    begin = np.cumsum(lengths) - lengths
    n = np.maximum(lengths - length + 1, 0)
    starts = ragged(begin, n)  # of all strings inside one text
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none, none, hashes
    of = np.repeat(np.arange(len(lengths)), n)
    grams = np.arange(len(data) - q + 1)
    h = hashes.of(grams, grams + q)
    owner = window_minima(h >> np.uint64(24), length - q + 1)[starts]
    change = np.concatenate([[True], (owner[1:] != owner[:-1]) | (of[1:] != of[:-1])])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(owner)) - 1
    return of[first], owner[first], h[owner[first]], starts[first], starts[last], hashes


def _rows(length: int):
    """Per anchor: bucket (hash of its q-gram), context hash, row key, place of the context, its strings' number, and where the anchor stands in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            keys = [b.column(c).to_numpy() for c in ("key_id", "key_text")]
            for i, j in text_chunks(texts, CHUNK_BYTES):
                lengths = np.array([len(t) for t in texts[i:j]], dtype=np.int64)
                of, place, gram, first, last, hashes = anchors(np.frombuffer(b"".join(texts[i:j]), dtype=np.uint8), lengths, length)
                if len(place):
                    # The context and where the anchor stands in it.
                    context = hashes.of(first, last + length) ^ mix64((place - first).astype(np.uint64) + np.uint64(1))
                    begin = np.cumsum(lengths) - lengths
                    columns = (gram.view(np.int64), context.view(np.int64), keys[0][i + of], keys[1][i + of], (first - begin[of]).astype(np.int32), (last - first + 1).astype(np.int32), (place - first).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "context", "key_id", "key_text", "first", "n", "anchor"])
        give_back()

    return run


ROWS = "gram long, context long, key_id long, key_text long, first int, n int, anchor int"
PARTS = "bucket long, part long, copies long, bytes binary, anchor int"
REPEATS = "bucket long, part long, at int, n int, bits binary"


def refined(buckets: np.ndarray, data: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int, q: int = 8) -> np.ndarray:
    """Final bucket of each string of `length` bytes that starts at one of `starts` in data.

    buckets: first bucket of each start; ends: end of the text of each place of data. Places whose string of h bytes
    would run over its text's end have no bucket of that step.
    """
    at = np.arange(len(data))
    pointer = np.zeros(len(data), dtype=np.int64)
    grams = np.zeros(len(data), dtype=np.uint64)
    for k in range(q):
        grams[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(8 * k)
    pointer = np.unique(grams, return_inverse=True)[1]
    h = q
    while 2 * h <= length:
        # A string of 2h bytes is told by the pointers at its start and h bytes on.
        later = np.minimum(at + h, len(data) - 1)
        pointer = np.unique(pointer * (int(pointer.max()) + 1) + pointer[later], return_inverse=True)[1]
        h *= 2
    # Of h-byte strings, one at the start and one that ends with it, and those between.
    key = buckets
    offsets = list(range(0, length - h + 1, h))
    if offsets[-1] != length - h:
        offsets.append(length - h)
    for o in offsets:
        key = np.unique(key, return_inverse=True)[1]
        key = key * (int(pointer.max()) + 1) + pointer[starts + o]
    return np.unique(key, return_inverse=True)[1]


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


SPLIT = f"{PARTS}, at int, old_bucket long, old_part long"


def _split(length: int, level: int):
    """Parts of the strings whose anchor stands at like places in them, in buckets by all bytes that such strings have in common."""
    top = length - length // 2  # the anchor's last place in a string
    width = 1 << max(0, top.bit_length() - level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for bucket, part, copies, data, anchor in zip(*(b.column(c).to_pylist() for c in ("bucket", "part", "copies", "bytes", "anchor")), strict=True):
                least = anchor - (len(data) - length)  # of the last string; the first one's is anchor
                for g in range(least // width, anchor // width + 1):
                    low, high = g * width, min((g + 1) * width - 1, top)
                    start, stop = max(0, anchor - high), anchor - max(low, least) + length
                    new = _hash(struct.pack("<qii", bucket, level, g), data[anchor - low : anchor - high + length])
                    own = data[start:stop]
                    out.append((new, _hash(struct.pack("<i", anchor - start), own), copies, own, anchor - start, start, bucket, part))
            yield _batch(out, SPLIT)

    return run


def _refine(length: int):
    """Per part: which of its strings occur more than once (a bit for each string), if any does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, bytes, int]] = []
        size = 0

        def settle() -> pa.RecordBatch:
            texts = [r[3] for r in rows]
            lengths = np.array([len(t) for t in texts])
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            begin = np.cumsum(lengths) - lengths
            n = lengths - length + 1
            starts = ragged(begin, n)
            of = np.repeat(np.arange(len(rows)), n)
            gram = np.array([r[0] for r in rows])
            # Strings of one bucket whose anchor stands at the same place in them.
            inside = starts - begin[of] - np.array([r[4] for r in rows])[of]
            bucket = np.unique(np.unique(gram, return_inverse=True)[1][of] * (4 * length) + inside + 2 * length, return_inverse=True)[1]
            final = refined(bucket, data, np.repeat(begin + lengths, lengths), starts, length)
            copies = np.array([r[2] for r in rows])
            often = np.bincount(final, weights=copies[of])[final] > 1.5
            cuts = np.cumsum(n)[:-1]
            out = [(r[0], r[1], 0, len(x), np.packbits(x).tobytes()) for r, x in zip(rows, np.split(often, cuts), strict=True) if x.any()]
            return _batch(out, REPEATS)

        for b in batches:  # sorted by bucket: a bucket's rows follow each other
            for r in zip(*(b.column(c).to_pylist() for c in ("bucket", "part", "copies", "bytes", "anchor")), strict=True):
                if size > CHUNK_BYTES and r[0] != rows[-1][0]:
                    yield settle()
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3])
        if rows:
            yield settle()
        give_back()

    return run


def _strip(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, t, found in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("found").to_pylist(), strict=True):
                t = t or b""
                if not found:
                    out.append((d, len(t), 0, 0, t))
                    continue
                at = np.sort(np.concatenate([f["first"] + (np.arange(f["n"]) if f["bits"] is None else np.flatnonzero(np.unpackbits(np.frombuffer(f["bits"], np.uint8), count=f["n"]))) for f in found]))
                gap = np.flatnonzero(np.diff(at) > length)
                starts, stops = at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)] + length
                kept = b"".join(t[i:j] for i, j in zip([0, *stops.tolist()], [*starts.tolist(), len(t)], strict=True))
                out.append((d, len(t), len(t) - len(kept), len(starts), kept))
            yield _batch(out, KEPT)
        give_back()

    return run


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the asked contexts."""
    for b in batches:
        out = []
        for t, asked in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("asked").to_pylist(), strict=True):
            out += [(a["gram"], a["context"], a["copies"], t[a["first"] : a["first"] + a["size"]], a["anchor"]) for a in asked]
        yield _batch(out, PARTS)


def repeats_of(parts: DataFrame, n: int, length: int, scratch: Scratch) -> DataFrame:
    """Per part (PARTS, no two rows of one bucket and part) the strings that occur more than once in its bucket (REPEATS).

    Buckets of at most TASK_PARTS parts are refined inside a task. Larger ones, of whatever size, are split over the
    cluster: strings are told apart by where the anchor stands in them, in ever narrower ranges, and their buckets by
    all bytes that the strings of a range have in common. Equal parts become one, with the sum of copies. Once a range
    holds one place, all strings of a bucket are equal and one part is left: there are as many rounds at most as the
    place has bits.
    """
    done: list[DataFrame] = []
    links: list[DataFrame] = []
    while True:
        hot = scratch.save(parts.groupBy("bucket").agg(F.count("*").alias("kinds")).where(F.col("kinds") > TASK_PARTS).select("bucket"), "hot-buckets")
        some = not hot.isEmpty()
        cool = parts.join(hot, "bucket", "left_anti") if some else parts
        done.append(scratch.save(cool.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_refine(length), REPEATS), "repeats"))
        if not some:
            break
        split = scratch.save(parts.join(hot, "bucket").select("bucket", "part", "copies", "bytes", "anchor").mapInArrow(_split(length, len(done)), SPLIT), "split-parts")
        links.append(split.select("bucket", "part", F.col("at").alias("shift"), "old_bucket", "old_part"))
        parts = scratch.save(split.groupBy("bucket", "part").agg(F.sum("copies").alias("copies"), F.min("bytes").alias("bytes"), F.min("anchor").alias("anchor")), "parts")
    out = done.pop()
    while links:
        back = links.pop().join(out, ["bucket", "part"]).select(F.col("old_bucket").alias("bucket"), F.col("old_part").alias("part"), (F.col("shift") + F.col("at")).cast("int").alias("at"), "n", "bits")
        out = done.pop().unionByName(back)
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *row_key(doc_id, text))
    with Scratch(docs.sparkSession) as scratch:
        by_row = saved(_repeats_by_row(rows, length, scratch), "repeats-by-row")
    return rows.join(by_row, ["key_id", "key_text"], "left").select("doc_id", "text", "found").mapInArrow(_strip(length), KEPT)


def _repeats_by_row(rows: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    n = partitions(rows.sparkSession)
    each = scratch.save(rows.mapInArrow(_rows(length), ROWS), "anchors")
    # Written first: a join straight on the aggregate could not be split where one bucket holds many anchors.
    buckets = scratch.save(each.groupBy("gram").agg(F.count("*").alias("all"), (F.min("context") != F.max("context")).alias("mixed")).where("all > 1").select("gram", "mixed"), "buckets")
    live = scratch.save(each.join(buckets, "gram"), "live-anchors")
    scratch.drop(each, buckets)
    mixed = live.where("mixed").groupBy("gram", "context").agg(F.count("*").alias("copies"), F.min(F.struct("key_id", "key_text", "first", "n", "anchor")).alias("one")).select("gram", "context", "copies", "one.*")
    asked = scratch.save(mixed.groupBy("key_id", "key_text").agg(F.collect_list(F.struct("gram", "context", "copies", "first", (F.col("n") + F.lit(length - 1)).alias("size"), "anchor")).alias("asked")), "asked")
    # Repeated rows are cut each; one is enough.
    parts = scratch.save(rows.join(asked, ["key_id", "key_text"]).select("text", "asked").mapInArrow(_cut, PARTS).dropDuplicates(["bucket", "part"]), "parts")
    found = repeats_of(parts, n, length, scratch).select(F.col("bucket").alias("gram"), F.col("part").alias("context"), "at", F.col("n").alias("n_at"), "bits")
    some = live.where("mixed").join(found, ["gram", "context"]).select("key_id", "key_text", (F.col("first") + F.col("at")).alias("first"), F.col("n_at").alias("n"), "bits")
    whole = live.where("not mixed").select("key_id", "key_text", "first", "n", F.lit(None).cast("binary").alias("bits"))
    # The same row again is a copy: it counts, but needs its places once.
    return whole.unionByName(some).distinct().groupBy("key_id", "key_text").agg(F.collect_list(F.struct("first", "n", "bits")).alias("found"))


def digested(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
