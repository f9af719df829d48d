"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents are cut into pieces of at most `capacity` tokens; only longer ones are cut. Pieces and gaps are range-sorted
by their size, a domain of `capacity` values whatever the input, so that the sweep over it has a fixed bound: piece
lengths go in descending order, and each round matches all pieces of one length with their successor, the smallest
sufficient gap. Conflicts are resolved by rank: the r-th piece of a length takes the r-th place of the gap class; the
gaps are updated in bulk, pieces that found no place go to the next gap class in the next round, and to new sequences
where no gap is left. A round is a handful of numbers (a range of ranks, a range of sequences), never rows.

Ranks are distributed: pieces of a length are dealt by a hash of their id into salts, numbered inside the salt, and
shifted by the counts of the salts before it, so that no length, however frequent, meets in one task.

Defined results: null and empty texts are one piece of the end id; repeated rows are packed each; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of, encoder, give_back, partitions, saved, text_chunks

CAPACITY = 2048
TEXT_BYTES = 8_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = b.column("doc_id")
            for i, j in text_chunks(texts, TEXT_BYTES):
                flat, counts = enc.encode_flat(texts[i:j], end_id)
                n = -(-counts // capacity)
                of = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(counts[of] - start, capacity)
                begin = (np.cumsum(counts) - counts)[of] + start
                crcs = [crc32_of(flat[x:y]) for x, y in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def best_fit_rounds(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rounds of the sweep as rows (length, first rank, pieces, pieces a sequence, first sequence, first offset), and the number of sequences."""
    gaps: dict[int, list[list[int]]] = {}  # size of a gap -> ranges [first sequence, number]
    sizes: list[int] = []  # of the gaps there are, ascending
    rounds: list[tuple[int, int, int, int, int, int]] = []
    n_sequences = 0

    def put(size: int, first: int, number: int) -> None:
        if size and number:
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            gaps[size].append([first, number])

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(at)
            else:
                gap, first, number = capacity, n_sequences, -(-left // (capacity // length))
                n_sequences += number
            each = gap // length
            full = min(number, left // each)
            if full:
                rounds.append((length, rank, full * each, each, first, capacity - gap))
                rank, left = rank + full * each, left - full * each
                put(gap - each * length, first, full)
            if full < number and left:
                # Fewer pieces are left than one more sequence takes.
                rounds.append((length, rank, left, left, first + full, capacity - gap))
                put(gap - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(gap, first + full, number - full)
    return np.array(rounds, dtype=np.int64).reshape(-1, 6), n_sequences


def ranked(pieces: DataFrame) -> DataFrame:
    """pieces with rank: a number from 0 within their length."""
    salts = max(16, partitions(pieces.sparkSession))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    inside = salted.withColumn("inside", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    return inside.join(before.select("length", "salt", "before"), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("inside") - 1).drop("salt", "inside", "before")


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with length) and their sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rounds, _ = best_fit_rounds(counts, capacity)
    rounds = rounds[np.lexsort((rounds[:, 1], rounds[:, 0]))]
    keys = rounds[:, 0] * 2**48 + rounds[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            r = rounds[np.searchsorted(keys, length * 2**48 + rank, side="right") - 1]
            nth = rank - r[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(r[:, 4] + nth // r[:, 3]), pa.array(r[:, 5] + nth % r[:, 3] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return packed(saved(pieces_of(docs, tokenizer, end_id, capacity, doc_id, text), "pieces"), capacity)
