"""Token ids in binary shards under a Re-Pair grammar.

Documents in ascending id order (of one id: by the hash of their text, then by the text) are cut into shards of about
SHARD_TOKENS ids. In each shard frequent pairs of neighbouring symbols are replaced by nonterminals, round after round,
until no pair is seen MIN_COUNT times. A round takes together the most frequent pairs: those seen at least a
ROUND_SHARE as often as the first one, and the ROUND_PAIRS first ones in any case; where matches overlap, every other
one from the left is replaced. Pairs never cross a document's end.

Shard format (little-endian): magic `RPG1`, then unsigned 32-bit: documents, rules, symbols, first nonterminal, bytes a
symbol; then per document: id (int64), id-is-null (uint8), number of ids (uint32), number of symbols (uint32); per
rule: left, right (uint32), expansion length (uint32); then the symbols. Any document is decoded from its own
symbols and the rules: see Shard.ids.

Shards are rows (part, ordinal, n_docs, n_tokens, shard) of a Parquet table in the shared folder, committed by Spark's own task
commit, so that a lost executor costs its tasks only.

Defined results: null text is empty and holds the end id only; null ids come first; repeated rows are stored each;
an empty table makes no shard; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_of, encoder, give_back, partitions, ragged, saved, text_chunks

MAGIC = b"RPG1"
SHARD_TOKENS = 1 << 20
MIN_COUNT = 24
ROUND_PAIRS = 512
ROUND_SHARE = 0.1
CELLS = 1 << 20
TEXT_BYTES = 8_000_000


def _cells(pairs: np.ndarray) -> np.ndarray:
    """A cell number below CELLS of each pair."""
    return ((pairs * -7046029254386353131) >> 44) & (CELLS - 1)


def re_pair(ids: np.ndarray, first: int, end_id: int, min_count: int = MIN_COUNT, round_pairs: int = ROUND_PAIRS, round_share: float = ROUND_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rules[i] is the pair behind nonterminal first + i; end_id is never part of a pair. Afterwards no pair is seen min_count times."""
    seq = ids.astype(np.int64)
    rules: list[np.ndarray] = []
    n_rules = 0
    while len(seq) > 1:
        pairs = (seq[:-1] << 32) | seq[1:]
        cell = _cells(pairs)
        stop = seq == end_id
        cell[stop[:-1] | stop[1:]] = CELLS
        load = np.bincount(cell, minlength=CELLS + 1)
        load[CELLS] = 0
        # Only pairs in cells of min_count pairs can be frequent; they alone are sorted.
        at = np.flatnonzero(load[cell] >= min_count)
        ordered = np.sort(pairs[at])
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else at
        counts = np.diff(np.append(edge, len(ordered)))
        often = np.flatnonzero(counts >= min_count)
        if not len(often):
            break
        often = often[np.argsort(-counts[often], kind="stable")]
        often = often[: max(round_pairs, int((counts[often] >= round_share * counts[often[0]]).sum()))]
        chosen = np.sort(ordered[edge[often]])
        # One pair a cell; another one of the same cell waits for the next round.
        slot = np.full(CELLS + 1, -1, dtype=np.int32)
        slot[_cells(chosen)] = np.arange(len(chosen))
        chosen = chosen[np.sort(slot[_cells(chosen)][np.unique(_cells(chosen), return_index=True)[1]])]
        slot[_cells(chosen)] = np.arange(len(chosen))
        which = slot[cell]
        at = np.flatnonzero(which >= 0)
        at = at[chosen[which[at]] == pairs[at]]
        which = which[at]
        start = np.concatenate([[True], at[1:] != at[:-1] + 1])
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        keep = run % 2 == 0
        at, which = at[keep], which[keep]
        seq[at] = first + n_rules + which
        stay = np.ones(len(seq), dtype=bool)
        stay[at + 1] = False
        seq = seq[stay]
        rules.append(np.stack([chosen >> 32, chosen & 0xFFFFFFFF], axis=1))
        n_rules += len(chosen)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    out = np.ones(len(rules), dtype=np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return out


def write_shard(doc_ids: list[int | None], ids: list[np.ndarray], end_id: int) -> bytes:
    """A shard of documents; each array of ids ends with end_id."""
    flat = np.concatenate(ids)
    first = int(flat.max()) + 1
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    # Only the last id of a document is its end; the same id inside a text is an ordinary one under another number.
    marked = flat.astype(np.int64)
    ends = np.cumsum(lengths) - 1
    marked[ends] = 2**31 - 1
    symbols, rules = re_pair(marked, first, 2**31 - 1)
    stops = np.flatnonzero(symbols == 2**31 - 1)
    symbols[stops] = end_id
    per_doc = np.diff(np.concatenate([[-1], stops]))
    width = 2 if first + len(rules) <= 65536 else 4
    return b"".join([
        MAGIC, struct.pack("<5I", len(ids), len(rules), len(symbols), first, width),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        lengths.astype("<u4").tobytes(), per_doc.astype("<u4").tobytes(),
        rules.astype("<u4").tobytes(), expansion_lengths(rules, first).astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes(),
    ])


class Shard:
    """Reads a shard; documents are decoded one by one or all together."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        n, r, s, self.first, width = struct.unpack_from("<5I", data, 4)
        at = 24

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got

        ids, null = take("<i8", n), take("u1", n)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.lengths, self.per_doc = take("<u4", n).astype(np.int64), take("<u4", n).astype(np.int64)
        self.rules = take("<u4", 2 * r).reshape(-1, 2).astype(np.int64)
        self.expanded = take("<u4", r).astype(np.int64)
        self.symbols = take(f"<u{width}", s)
        self.offsets = np.cumsum(self.per_doc) - self.per_doc
        self.starts = np.cumsum(self.expanded) - self.expanded
        self.body = np.zeros(int(self.expanded.sum()), dtype=np.uint32)
        for i, (a, b) in enumerate(self.rules.tolist()):
            here = int(self.starts[i])
            for x in (a, b):
                if x >= self.first:
                    k = x - self.first
                    n = int(self.expanded[k])
                    self.body[here : here + n] = self.body[self.starts[k] : self.starts[k] + n]
                else:
                    n = 1
                    self.body[here] = x
                here += n

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        rule = symbols >= self.first
        k = np.where(rule, symbols - self.first, 0)
        sizes = np.where(rule, self.expanded[k] if len(self.rules) else 1, 1)
        out = np.zeros(int(sizes.sum()), dtype=np.uint32)
        ends = np.cumsum(sizes)
        out[(ends - sizes)[~rule]] = symbols[~rule]
        if rule.any():
            out[ragged((ends - sizes)[rule], sizes[rule])] = self.body[ragged(self.starts[k[rule]], sizes[rule])]
        return out

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document alone."""
        return self._expand(self.symbols[self.offsets[i] : self.offsets[i] + self.per_doc[i]])

    def all_ids(self) -> list[np.ndarray]:
        return np.split(self._expand(self.symbols), np.cumsum(self.lengths)[:-1])


def shards_of(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(part, ordinal, n_docs, n_tokens, shard), in ascending id order by part, then ordinal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, ordinal = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        owners: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([ordinal], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([size], pa.int64()), pa.array([write_shard(owners, ids, end_id)], pa.binary())], ["part", "ordinal", "n_docs", "n_tokens", "shard"])

        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            keys = b.column("doc_id").to_pylist()
            for i, j in text_chunks(texts, TEXT_BYTES):
                flat, counts = enc.encode_flat(texts[i:j], end_id)
                for d, x in zip(keys[i:j], np.split(flat, np.cumsum(counts)[:-1]), strict=True):
                    ids.append(x)
                    owners.append(d)
                    size += len(x)
                    if size >= shard_tokens:
                        yield flush()
                        ids, owners, size, ordinal = [], [], 0, ordinal + 1
        if ids:
            yield flush()
        give_back()

    n = partitions(docs.sparkSession)
    # Rows that are equal in id and text are dealt at random: any order among them is the same.
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("key_text"), F.rand(1).alias("salt"))
    ordered = keyed.repartitionByRange(n, "doc_id", "key_text", "salt").sortWithinPartitions("doc_id", "key_text", "text").select("doc_id", "text")
    return ordered.mapInArrow(run, "part int, ordinal int, n_docs long, n_tokens long, shard binary")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, ordinal, data in zip(*(b.column(c).to_pylist() for c in ("part", "ordinal", "shard")), strict=True):
            s = Shard(data)
            n = len(s.doc_ids)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([ordinal] * n, pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(np.cumsum(s.lengths) - s.lengths), pa.array(s.lengths), pa.array([crc32_of(x) for x in s.all_ids()], pa.int64()), pa.array(s.per_doc)], ["part", "ordinal", "doc_id", "inside", "n_tokens", "ids_crc32", "n_symbols"])


def documents_of(shards: DataFrame) -> DataFrame:
    """Reads shards back: doc_id, start, n_tokens, ids_crc32, n_symbols."""
    sizes = shards.select("part", "ordinal", "n_tokens")
    by_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # as many rows as partitions
    part_start = by_part.withColumn("part_start", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "part_start")
    inside_part = sizes.withColumn("before", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("ordinal")) - F.col("n_tokens")).select("part", "ordinal", "before")
    starts = inside_part.join(part_start, "part").select("part", "ordinal", (F.col("before") + F.col("part_start")).alias("first"))
    rows = shards.select("part", "ordinal", "shard").mapInArrow(_documents, "part int, ordinal int, doc_id long, inside long, n_tokens long, ids_crc32 long, n_symbols long")
    return rows.join(starts, ["part", "ordinal"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "n_symbols")


def token_documents(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards of docs to the shared folder and reads them back."""
    return documents_of(saved(shards_of(docs, tokenizer, end_id, doc_id, text), "shards", codec="lz4"))
