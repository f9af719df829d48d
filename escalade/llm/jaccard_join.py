"""N-gram Jaccard join with PartEnum signatures, and the classes of its links.

A document's set holds the 64-bit hashes of its distinct 5-word shingles (words: A-Z lower-cased, maximal runs of
`[^\\x20\\x09-\\x0D]`); with fewer words, the whole sequence is one shingle; without words the set is empty and linked
with nothing. Two documents link when 100 * |intersection| >= 75 * |union|.

Signatures. Sizes fall into bands [2^j, 2^(j+1)); instance j compares sets of band j with each other and with those
sets of band j+1 that are small enough to link with one of band j. Linked sets of sizes m and n differ in at most
(m + n) / 7 elements, those of instance j in at most k = floor(M / 3), M = 2^(j+1) - 1. Shingles are hashed into n1
first-level parts of n2 = 3 second-level parts each, n1 somewhat over k / 2. Each of the three subsets of two
second-level parts of a part is a signature of the set, if it is not empty.

What a set shares with a partner. A first-level part in which a set fills two or three second-level parts gives it a
signature in common with the partner unless two of the differences lie there; one in which it fills one, unless one
difference lies there. So differ in at most `most` elements, and the set shares at least its `spare` with every partner:
the number of such parts less those that `most` differences can spoil. `most` follows from the set's own size. Sets
of no spare (small ones) also give each of their floor(size / 4) + 1 least hashes as a signature of the instance;
two linked sets without spare share one of these, so that no link is lost.

Holders. Equal sets are one node (their digest); one of their texts, whichever partial aggregates meet first, is signed
and compared for all, so that copies cost no signatures.

Groups. Sets under one signature: up to ALL_PAIRS of them give all pairs; larger groups give a star around their least
member, and their members are noted. Buckets of signatures are read in pieces of MOST_SIGNATURES; what a bucket needs
between pieces is one member for each signature.

Few notes are needed. Let the notes of a set be in order of their groups' sizes, largest first. Of the signatures that
two linked sets share, at least `spare` for either of them, the one of the smallest group stands behind spare - 1 others
in both orders. So each set's first spare - 1 notes go, and every pair still meets in a group or has met in a small one.
Common passages, which make large groups, thus weigh only with sets that mostly consist of them.

Once the first classes are known, groups that hold several classes are bundled by their most frequent class, and the
members of a bundle, each once, are compared with those of other classes, in blocks, twice: first a forest of the pairs
that may link joins most classes, then all pairs that still lie in different classes and may link follow. So a group of
near copies of any size costs rows in proportion to its size, and yet every pair that could join two classes is compared.
Pairs meet as sketches, the parities of the numbers of a set's hashes in some cells: an element more or less changes one
parity, so pairs with more than floor((n1 + n2) / 7) differing cells go, and no linked pair does. What is left is
verified on the whole sets.

Defined results: null or wordless text has size 0 and is its own class; copies and repeated rows share a class; a
null doc_id never becomes a class id unless all ids of the class are null; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Forest, Scratch, components, few, give_back, mix64, partitions, ragged, row_key, saved, text_chunks

SHINGLE = 5
ALL_PAIRS = 12
BLOCK = 256
SUBPARTS = 3
SLACK = 1.2
CHUNK_BYTES = 500_000
#: Shingles a bucket is planned for, and signatures that a task holds at a time.
BUCKET_SHINGLES = 1 << 19
MOST_SIGNATURES = 1 << 21
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_MUL = _RNG.integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)])) for b in (_BASE, _BASE_INV)]
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of the texts, in order, and the number of words of each text."""
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    data = _LOWER[joined]
    gap = _SPACE[data]
    begin = ~gap
    begin[1:] &= gap[:-1]
    starts = np.flatnonzero(begin)
    last = ~gap[:-1] & gap[1:]
    ends = np.flatnonzero(last) + 1
    up, down = _powers(len(data))
    sums = np.cumsum(_BYTE[data] * up[: len(data)])
    total = sums[ends - 1]
    total -= np.where(starts > 0, sums[starts - 1], np.uint64(0))
    words = mix64(total * down[starts] + (ends - starts).astype(np.uint64))
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, ends_of)]))
    return words, counts


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts)
    if len(words) >= SHINGLE:
        n = len(words) - SHINGLE + 1
        sums = np.zeros(n, dtype=np.uint64)
        for i in range(SHINGLE):
            sums += words[i : i + n] * _MUL[i]
        rolled = mix64(sums)
    out, at = [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            out.append(np.unique(rolled[at : at + n - SHINGLE + 1]))
        elif n:
            short = np.uint64(0)
            for i in range(n):
                short = short + words[at + i : at + i + 1] * _MUL[i]
            out.append(mix64(short + _MUL[SHINGLE] * np.uint64(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def digest(s: np.ndarray) -> int:
    """64-bit identity of a set, as a signed number."""
    return int(mix64(np.array([mix64(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    """Parities of the numbers of hashes with equal low bits, in a power of two of cells, two to four for each hash."""
    cells = 2 ** max(6, int(len(s)).bit_length() + 1)
    return np.packbits(np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1).tobytes()


def folded(x: bytes, size: int) -> np.ndarray:
    """The sketch of `size` bytes that has the low bits of a longer one."""
    return np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, size // 8), axis=0)


def least_difference(x: bytes, y: bytes) -> int:
    """At most the number of elements in which the sets of two sketches differ: an element changes one parity."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = pa.array([least_difference(x, y) <= (m + n) // 7 for x, y, m, n in zip(*(b.column(c).to_pylist() for c in ("sx", "sy", "nx", "ny")), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])


def possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """pairs(a, b) whose sketches allow a link."""
    x, y = (sketches.select(F.col("set_id").alias(k), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}")) for k, s in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").mapInArrow(_near, "a long, b long")


def first_parts(instance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n1, floor(k / 2)) of instances j."""
    k = (2 ** (instance + 1) - 1) // 3
    half = k // 2
    return np.where(half == 0, 1, (half * SLACK).astype(np.int64) + 2), half


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) of all sets; empty sets have none."""
    return signed(sets)[:2]


def signed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, index of its set) of all sets, and each set's spare: at least so many signatures of parts it shares with any partner."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    own = np.flatnonzero(sizes > 0)
    band = np.floor(np.log2(np.maximum(sizes, 1) + 0.5)).astype(np.int64)
    # -(-3 s // 4): the smallest partner of a set of s elements.
    lower = own[(-(-3 * sizes[own] // 4) < 2 ** band[own]) & (band[own] > 0)]
    who, inst = np.concatenate([own, lower]), np.concatenate([band[own], band[lower] - 1])
    if not len(who):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(sets), np.int64)
    n1, _ = first_parts(inst)
    base = np.concatenate([[0], np.cumsum(n1)])
    sums = np.zeros((int(base[-1]), SUBPARTS), dtype=np.uint64)
    filled = np.zeros((int(base[-1]), SUBPARTS), dtype=bool)
    flat = np.concatenate(sets)
    offsets = np.cumsum(sizes) - sizes
    elements = flat[ragged(offsets[who], sizes[who])]
    entry = np.repeat(np.arange(len(who)), sizes[who])
    salted = mix64(elements + (inst[entry].astype(np.uint64) + np.uint64(1)) * _BASE)
    part = (salted >> np.uint64(33)) % n1[entry].astype(np.uint64)
    cell = (base[entry] + part.astype(np.int64)) * SUBPARTS + ((salted & np.uint64(0xFFFFFF)) % np.uint64(SUBPARTS)).astype(np.int64)
    np.add.at(sums.reshape(-1), cell, mix64(salted + np.uint64(7)))
    filled.reshape(-1)[cell] = True
    row_entry = np.repeat(np.arange(len(who)), n1)
    row_part = np.arange(int(base[-1])) - base[:-1][row_entry]
    n_filled = filled.sum(axis=1)
    single, solid = (np.bincount(row_entry, weights=w, minlength=len(who)).astype(np.int64) for w in (n_filled == 1, n_filled >= 2))
    # Partners in the own instance have up to 4/3 of the size, those in the lower one are of the lower band.
    size = sizes[who]
    most = (size + np.where(inst == band[who], 4 * size // 3, 2 ** (inst + 1) - 1)) // 7
    left = single + solid - np.where(most > single, single + (most - single) // 2, most)
    risky = left <= 0
    spare = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(spare, who, left)
    total = sums.sum(axis=1, dtype=np.uint64)
    out, ids = [], []
    for drop in range(SUBPARTS):
        rest = n_filled - filled[:, drop]
        keep = rest > 0
        tag = (inst[row_entry] * 1_000_003 + row_part * SUBPARTS + drop).astype(np.uint64)
        out.append(mix64((total - sums[:, drop])[keep] * np.uint64(3) + mix64(tag[keep] + np.uint64(11))))
        ids.append(who[row_entry[keep]])
    least = sizes[who[risky]] // 4 + 1
    out.append(mix64(flat[ragged(offsets[who[risky]], least)] * np.uint64(5) + mix64(np.repeat(inst[risky], least).astype(np.uint64) + np.uint64(999_999_937))))
    ids.append(np.repeat(who[risky], least))
    return np.concatenate(out), np.concatenate(ids), spare


def _as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = _as_bytes(b.column("text"))
        for i, j in text_chunks(texts, CHUNK_BYTES):
            sets = shingle_sets(texts[i:j])
            own = [b.column(c).slice(i, j - i) for c in ("doc_id", "key_id", "key_text", "text")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.int64()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())], ["doc_id", "key_id", "key_text", "text", "n_shingles", "set_id", "sketch"])
    give_back()


BLOBS = "bucket long, sig binary, counts binary, ids binary, sizes binary, spare binary"


def _member_blobs(buckets: int):
    """Signatures of a chunk of sets, one row for each bucket: low halves of the signatures, and for each set their number, its id, size and spare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, all_ids = _as_bytes(b.column("text")), b.column("set_id").to_numpy()
            for i, j in text_chunks(texts, CHUNK_BYTES):
                sets, ids = shingle_sets(texts[i:j]), all_ids[i:j]
                sig, who, spare = signed(sets)
                bucket = ((sig >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                place = bucket * len(sets) + who
                order = np.argsort(place, kind="stable")
                low, place = (sig[order] & np.uint64(0xFFFFFFFF)).astype("<u4"), place[order]
                # Signatures of a set that have the same low half count once.
                halves = np.sort((who.astype(np.uint64) << np.uint64(32)) | (sig & np.uint64(0xFFFFFFFF)))
                np.subtract.at(spare, (halves[1:][halves[1:] == halves[:-1]] >> np.uint64(32)).astype(np.int64), 1)
                first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else place
                counts = np.diff(np.append(first, len(place))).astype("<u4")
                bucket, who = place[first] // len(sets), place[first] % len(sets)
                columns = (counts, ids[who].astype("<i8"), np.array([len(s) for s in sets], "<u4")[who], np.clip(spare, -(2**30), 2**30).astype("<i4")[who])
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else bucket
                rows = []
                for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
                    end = int(first[y]) if y < len(first) else len(low)
                    rows.append((int(bucket[x]), low[first[x] : end].tobytes(), *(c[x:y].tobytes() for c in columns)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 6))], ["bucket", "sig", "counts", "ids", "sizes", "spare"])
        give_back()

    return run


def _group_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig null, a, b): pairs to verify; rows (sig, a, b): member a of a large group and its spare. The rows of a bucket follow each other in one task."""
    bucket, held, size = -1, [], 0
    met = (np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket:
                if held:
                    yield from _pairs_and_notes(bucket, held, met, False)[0]
                bucket, held, size = row["bucket"], [], 0
                met = tuple(x[:0] for x in met)
            elif size > MOST_SIGNATURES:
                rows, met = _pairs_and_notes(bucket, held, met, True)
                yield from rows
                held, size = [], 0
            held.append(row)
            size += len(row["sig"]) // 4
    if held:
        yield from _pairs_and_notes(bucket, held, met, False)[0]
    give_back()


def _pairs_and_notes(bucket: int, held: list[dict], met: tuple[np.ndarray, ...], more: bool) -> tuple[list[pa.RecordBatch], tuple[np.ndarray, ...]]:
    """Rows of one piece of a bucket, and signature, first member and its spare of all that the bucket has shown so far (if more follows)."""
    counts = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in held])
    sig = np.concatenate([np.frombuffer(r["sig"], "<u4") for r in held])
    ids, sizes, spare = (np.repeat(np.concatenate([np.frombuffer(r[c], kind) for r in held]).astype(np.int64), counts) for c, kind in (("ids", "<i8"), ("sizes", "<u4"), ("spare", "<i4")))
    several = more or len(met[0]) > 0
    order = np.argsort(sig, kind="stable")
    if not several:
        # Most signatures stand alone.
        same = sig[order[1:]] == sig[order[:-1]]
        shared = np.zeros(len(sig), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        order = order[shared]
    sig, ids, sizes, spare = sig[order], ids[order], sizes[order], spare[order]
    order = np.lexsort((ids, sig))
    sig, ids, sizes, spare = sig[order], ids[order], sizes[order], spare[order]
    once = np.ones(len(sig), dtype=bool)
    once[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
    sig, ids, sizes, spare = sig[once], ids[once], sizes[once], spare[once]
    head = np.ones(len(sig), dtype=bool)
    head[1:] = sig[1:] != sig[:-1]
    starts = np.flatnonzero(head)
    counts = np.diff(np.append(starts, len(sig)))
    pos = np.arange(len(sig)) - np.repeat(starts, counts)
    count = np.repeat(counts, counts)
    a, b = [], []
    for step in range(1, ALL_PAIRS):  # a member with the one `step` after it
        at = np.flatnonzero((count <= ALL_PAIRS) & (pos + step < count))
        at = at[4 * np.minimum(sizes[at], sizes[at + step]) >= 3 * np.maximum(sizes[at], sizes[at + step])]
        a.append(ids[at])
        b.append(ids[at + step])
    large = np.flatnonzero((count > ALL_PAIRS) & (pos > 0))
    a.append(ids[large - pos[large]])
    b.append(ids[large])
    noted = count > (1 if several else ALL_PAIRS)
    notes = [(sig[noted], ids[noted], spare[noted])]
    if len(met[0]):
        place = np.minimum(np.searchsorted(met[0], sig), len(met[0]) - 1)
        again = np.flatnonzero(met[0][place] == sig)
        a.append(met[1][place[again]])
        b.append(ids[again])
        notes += [(sig[again], ids[again], spare[again]), (sig[again], met[1][place[again]], met[2][place[again]])]
    if more:
        fresh = starts if not len(met[0]) else starts[met[0][np.minimum(np.searchsorted(met[0], sig[starts]), len(met[0]) - 1)] != sig[starts]]
        met = tuple(np.concatenate([x, y[fresh]]) for x, y in zip(met, (sig, ids, spare), strict=True))
        order = np.argsort(met[0], kind="stable")
        met = tuple(x[order] for x in met)
    pairs = np.stack([np.concatenate(a), np.concatenate(b)], axis=1)
    pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
    note_sig, note_id, note_spare = (np.concatenate(x) for x in zip(*notes, strict=True))
    wide = (np.int64(bucket) << 32) | note_sig.astype(np.int64)
    return [
        pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["sig", "a", "b"]),
        pa.RecordBatch.from_arrays([pa.array(wide), pa.array(note_id), pa.array(note_spare)], ["sig", "a", "b"]),
    ], met


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = _as_bytes(b.column("text"))
        for i, j in text_chunks(texts, CHUNK_BYTES):
            yield pa.RecordBatch.from_arrays([b.column("set_id").slice(i, j - i), pa.array([s.tobytes() for s in shingle_sets(texts[i:j])], pa.binary())], ["set_id", "hashes"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            both = int((large[at] == small).sum())
            keep.append(100 * both >= 75 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], ["a", "b"])


def mixed_blocks(members: DataFrame, classes: DataFrame, sketches: DataFrame, scratch: Scratch) -> DataFrame:
    """Blocks (bundle, home, block, m) of about BLOCK members of those groups of members(sig, set_id) that hold several classes, bundled by their most frequent class; home: the members of that class."""
    placed = scratch.save(members.join(classes.withColumnRenamed("node", "set_id"), "set_id", "left").select("sig", "set_id", F.coalesce("component", "set_id").alias("component")), "placed")
    shares = placed.groupBy("sig", "component").agg(F.count("*").alias("k"))
    mixed = scratch.save(shares.groupBy("sig").agg(F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1").select("sig", F.col("top.component").alias("bundle")), "mixed")
    once = scratch.save(placed.join(mixed, "sig").select("bundle", "set_id", "component", (F.col("component") == F.col("bundle")).alias("home")).distinct(), "bundled")
    sizes = scratch.save(once.groupBy("bundle", "home").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "bundles")
    dealt = once.join(sizes, ["bundle", "home"]).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks"))).join(sketches, "set_id")
    blocks = scratch.save(dealt.groupBy("bundle", "home", "block").agg(F.collect_list(F.struct("set_id", "n", "component", "sketch")).alias("m")), "blocks", codec="lz4")
    scratch.drop(placed, mixed, once, sizes)
    return blocks


def across_classes(blocks: DataFrame, forest: bool) -> DataFrame:
    """Pairs (a, b) of members of one bundle's blocks that lie in different classes and whose sizes and sketches allow a link.

    A row holds two blocks of a bundle, not both of its own class, and only pairs that pass leave it: all of them, or,
    for a forest, those that join classes that the task's earlier pairs do not join.
    """
    x, y = (blocks.select("bundle", F.col("home").alias(f"home_{k}"), F.col("block").alias(f"block_{k}"), F.col("m").alias(k)) for k in ("x", "y"))
    return x.where("not home_x").join(y, "bundle").where("home_y or block_x <= block_y").select("x", "y").mapInArrow(_compare_blocks(forest), "a long, b long").distinct()


def _blocks(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    at, members = column.offsets.to_numpy(), column.values
    ids, n, of = (members.field(c).to_numpy() for c in ("set_id", "n", "component"))
    sketches = members.field("sketch")
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield ids[i:j], n[i:j], of[i:j], sketches.slice(i, j - i).to_pylist()


def _possible_pairs(left: tuple, right: tuple) -> np.ndarray:
    """(i, j) of members of two blocks that lie in different classes and whose sizes and sketches allow a link."""
    (x, nx, of_x, sx), (y, ny, of_y, sy) = left, right
    i, j = np.nonzero((of_x[:, None] != of_y) & (4 * np.minimum(nx[:, None], ny) >= 3 * np.maximum(nx[:, None], ny)) & (x[:, None] != y))
    if not len(i):
        return np.zeros((0, 2), np.int64)
    size = min(map(len, sx + sy))
    tx, ty = (np.stack([folded(s, size) for s in t]) for t in (sx, sy))
    step, keep = max(1, (1 << 20) // (size // 8)), []
    for k in range(0, len(i), step):
        a, b = i[k : k + step], j[k : k + step]
        keep.append(np.bitwise_count(tx[a] ^ ty[b]).sum(axis=1, dtype=np.int64) <= (nx[a] + ny[b]) // 7)
    return np.stack([i, j], axis=1)[np.concatenate(keep)]


def _joining(of_a: np.ndarray, of_b: np.ndarray, forest: Forest) -> list[int]:
    """Indices of pairs of classes that join what the forest and the pairs before them do not; the forest takes them up."""
    classes, local = np.unique(np.concatenate([of_a, of_b]), return_inverse=True)
    la, lb, left, out = local[: len(of_a)], local[len(of_a) :], np.arange(len(of_a)), []
    while len(left):
        roots = np.array([forest.root(c) for c in classes.tolist()], dtype=np.int64)
        left = left[roots[la[left]] != roots[lb[left]]]
        out += [k for k in left[np.sort(np.unique(roots[lb[left]], return_index=True)[1])].tolist() if forest.join(int(of_a[k]), int(of_b[k]))]
    return out


def _compare_blocks(forest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Forest()
        for batch in batches:
            for left, right in zip(_blocks(batch.column("x")), _blocks(batch.column("y")), strict=True):
                found = _possible_pairs(left, right)
                i, j = found[:, 0], found[:, 1]
                a, b = left[0][i], right[0][j]
                if forest:
                    order = np.lexsort((np.maximum(a, b), np.minimum(a, b)))
                    order = order[_joining(left[2][i[order]], right[2][j[order]], joined)]
                    a, b = a[order], b[order]
                if len(a):
                    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def whole_sets(holders: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(set_id, hashes) of the sets in pairs, each made again from its holder's text."""
    wanted = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct(), "wanted")
    return scratch.save(holders.select("set_id", "text").join(few(wanted), "set_id", "left_semi").mapInArrow(_whole_sets, "set_id long, hashes binary"), "whole-sets", codec="lz4")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of pairs(a, b), compared on the whole sets."""
    x = sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(x, "a").join(y, "b").mapInArrow(_similar, "a long, b long")


def keyed_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """jaccard_classes with the row's key (key_id, key_text) and class_id, a number of the class (null for empty sets)."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *row_key(doc_id, text), F.col(text).alias("text"))
        known = scratch.save(rows.mapInArrow(_set_rows, "doc_id long, key_id long, key_text long, text string, n_shingles long, set_id long, sketch binary"), "sets")
        holders = scratch.save(known.where("set_id is not null").select("set_id", F.col("n_shingles").alias("n"), "sketch", "text").dropDuplicates(["set_id"]), "holders")
        return saved(_with_component(known.drop("text", "sketch"), _classes(holders, scratch), scratch), "keyed-classes")


def _linked(pairs: DataFrame, holders: DataFrame, scratch: Scratch) -> DataFrame:
    sets = whole_sets(holders, pairs, scratch)
    links = scratch.save(verified(pairs, sets), "links")
    scratch.drop(sets)
    return links


def _classes(holders: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the linked sets of holders(set_id, n, sketch, text)."""
    n = partitions(holders.sparkSession)
    sketches = holders.select("set_id", "n", "sketch")
    total = holders.agg(F.sum("n")).first()[0] or 0
    blobs = holders.select("set_id", "text").mapInArrow(_member_blobs(n * (1 + total // (n * BUCKET_SHINGLES))), BLOBS)
    groups = scratch.save(blobs.repartitionById(n, (F.col("bucket") % n).cast("int")).sortWithinPartitions("bucket").mapInArrow(_group_rows, "sig long, a long, b long"), "groups")
    pairs = scratch.save(possible(groups.where("sig is null").select("a", "b").distinct(), sketches), "pairs")
    classes = components(_linked(pairs, holders, scratch), scratch=scratch)
    noted = groups.where("sig is not null").select("sig", F.col("a").alias("set_id"), F.col("b").alias("spare"))
    # Written first: a join straight on the aggregate could not be split where one group is large.
    sizes = scratch.save(noted.groupBy("sig").agg(F.count("*").alias("size")), "group-sizes")
    order = Window.partitionBy("set_id").orderBy(F.desc("size"), "sig")
    # A set has at most as many notes as signatures.
    ranked = noted.distinct().join(sizes, "sig").withColumn("rank", F.row_number().over(order))
    members = scratch.save(ranked.where("rank >= spare").select("sig", "set_id"), "members")
    scratch.drop(groups, sizes)
    for forest in (True, False):
        blocks = mixed_blocks(members, classes, sketches, scratch)
        if blocks.isEmpty():
            break
        across = scratch.save(across_classes(blocks, forest), "pairs")
        scratch.drop(blocks)
        if not across.isEmpty():
            # The known classes stand for the links that made them.
            classes = components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_linked(across, holders, scratch)), scratch=scratch)
    return classes


def _with_component(known: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    least = known.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    of_set = scratch.save(least.join(classes.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id")), "class-of-set")
    # Written first: a join straight on the aggregate could not be split where one class holds many sets.
    ids = scratch.save(of_set.groupBy("component").agg(F.min("least").alias("component_id")), "class-ids")
    by_set = of_set.join(ids, "component").select("set_id", "component_id", "component")
    return known.join(by_set, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "set_id", "key_id", "key_text", F.col("component").alias("class_id"))


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, set_id (equal for equal sets; null for empty ones)."""
    return keyed_classes(docs, doc_id, text).select("doc_id", "n_shingles", "component_id", "set_id")


def one_of_each_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with the least id of their class, one row a class; rows without words all stay. A null id stays only where the class has no other."""
    known = keyed_classes(docs, doc_id, text).where("class_id is not null")
    # Written first: a join straight on the aggregate could not be split where one class holds many rows.
    best = saved(known.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "key_id", "key_text")).alias("k")).select("class_id", F.col("k.key_id").alias("best_id"), F.col("k.key_text").alias("best_text")), "best")
    others = known.join(best, "class_id").where("key_id <> best_id or key_text <> best_text").select(F.col("key_id").alias("__key_id"), F.col("key_text").alias("__key_text"))
    key_id, key_text = row_key(doc_id, text)
    out = docs.withColumns({"__key_id": key_id, "__key_text": key_text}).join(few(saved(others.distinct(), "others")), ["__key_id", "__key_text"], "left_anti")
    twice = saved(known.groupBy("key_id", "key_text").count().where("count > 1").select(F.col("key_id").alias("__key_id"), F.col("key_text").alias("__key_text")), "repeated")
    if not twice.isEmpty():
        once = out.join(few(twice), ["__key_id", "__key_text"], "left_semi").dropDuplicates(["__key_id", "__key_text"])
        out = once.unionByName(out.join(few(twice), ["__key_id", "__key_text"], "left_anti"))
    return out.select(*docs.columns)
