"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: What a Python worker gets at a time.
BATCH_BYTES = "8m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; always through Spark's reader, so any store that Spark reads will do. Sets the session's Arrow batches to BATCH_BYTES, which bounds the memory of Python workers."""
    spark.conf.set(_BATCH, BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns unused memory of this worker to the system: workers outlive their tasks and stand beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. Where it is unset, a temporary one, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them see")
        base = f"file://{tempfile.mkdtemp(prefix='escalade-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: While a table is written: the shuffle files behind it go as soon as it is there, and Python workers get small batches.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", _BATCH: BATCH_BYTES}


def _written(df: DataFrame, path: str, codec: str) -> DataFrame:
    spark = df.sparkSession
    before = {k: spark.conf.get(k) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    return _written(df, fresh_path(df.sparkSession, name), codec)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one computation in the shared folder. drop() deletes those that nothing will read again; leaving the scope deletes the rest."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}  # by path

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.tables:
            delete(self.spark, path)
        self.tables = {}

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = fresh_path(self.spark, name)
        self.tables[path] = _written(df, path, codec)
        return self.tables[path]

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for p, t in self.tables.items() if any(t is x for x in tables)]:
            delete(self.spark, path)
            del self.tables[path]


#: Rows of some numbers each (8 to 16 bytes) that are broadcast at most.
BROADCAST_ROWS = 500_000


def few(keys: DataFrame) -> DataFrame:
    """A written table of keys, marked for broadcast if it has at most BROADCAST_ROWS rows; a larger one is joined by a shuffle."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod (null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two non-null columns that say which row this is: equal only for rows equal in id and text."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key_text")]


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start+1, ... of the given lengths."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_chunks(texts: list[bytes], limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about limit bytes; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


#: The printable stand-ins that byte-level vocabularies use for bytes, by their rule.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_STAND_IN = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(_SHOWN))}
#: Plain letters, and plain punctuation: a unit of a run of each is two pre-tokens under both vocabularies.
_LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
_SIGNS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"

_LARGE = {x: pa.scalar(x, pa.large_string()) for x in ("", " ")}


class UnitEncoder:
    """A tokenizers file with a bounded cache by unit; ids are those of the library's encode(text, add_special_tokens=False).

    Units are what single spaces and single line ends separate. Both pre-tokenizers in use never join characters across
    a single space that starts a unit, nor across a line end between two characters that are no white space, so the
    ids of a text are those of its units in order. A unit of plain letters and plain punctuation goes to the library's
    model as its two pre-tokens, any other one through the whole library. So do texts with white space beside white
    space and texts that may hold the string of a special token.
    """

    LIMIT = 1_200_000
    FIRST = "\x00"  # marks the first unit of a line, which no space precedes
    LINE = "\n"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: Texts with one of these go through the whole library: the first characters of the special tokens.
        self.apart = {self.FIRST, *(t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values())}
        kept = self._whole(" a") != self._whole("a")
        self.space = " " if kept else ""
        self.lowered = self._whole("A") == self._whole("a")
        self.line = self._whole("a\nb")[1:-1]
        self.signs: dict[str, list[int]] = {"": []}
        self.known = pa.array([], pa.large_string())
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _parts(self, pre_tokens: list[str]) -> tuple[list[int], list[int]]:
        """Ids of pre-tokens without line ends, one after the other, and the number of each one's ids."""
        shown = "\n".join(pre_tokens).encode().decode("latin-1").translate(_STAND_IN).split(chr(_STAND_IN[10])) if pre_tokens else []
        flat: list[int] = []
        sizes: list[int] = []
        for tokens in map(self.model.tokenize, shown):
            flat += [t.id for t in tokens]
            sizes.append(len(tokens))
        return flat, sizes

    def _sign(self, pre_token: str) -> list[int]:
        ids = self.signs.get(pre_token)
        if ids is None:
            if len(self.signs) > 20_000:
                self.signs = {"": []}
            ids = self.signs[pre_token] = self._parts([pre_token])[0]
        return ids

    def _other(self, unit: str) -> list[int] | None:
        """Ids of a unit without letters or with other characters; None if its text has white space beside white space there."""
        if unit == self.LINE:
            return self.line
        space, word = ("", unit[1:]) if unit[:1] == self.FIRST else (self.space, unit)
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        return self._whole(space + word) if word.strip(_SIGNS) else self._sign(space + word)

    def _places(self, units: pa.Array) -> np.ndarray:
        """Where units stand in the cache. A full one keeps the units that are needed now and drops the others."""
        # The cache is probed with the units' table, the smaller one to build.
        of_known = pc.index_in(self.known, value_set=units)
        there = np.flatnonzero(of_known.is_valid().to_numpy(zero_copy_only=False))
        at = np.full(len(units), -1, dtype=np.int64)
        at[of_known.drop_null().to_numpy()] = there
        unknown = at < 0
        new = units.filter(pa.array(unknown))
        if len(self.known) + len(new) > self.LIMIT:
            kept = at[~unknown]
            starts, self.sizes = self.starts[kept], self.sizes[kept]
            room = np.maximum(self.sizes, 0)
            self.known, self.ids, self.starts = self.known.take(pa.array(kept)), self.ids[ragged(starts, room)], np.cumsum(room) - room
            at[~unknown] = np.arange(len(kept))
        at[unknown] = len(self.known) + np.arange(len(new))
        if len(new):
            self._learn(new)
        return at

    def _learn(self, new: pa.Array) -> None:
        first = pc.starts_with(new, self.FIRST)
        words = pc.if_else(first, pc.utf8_slice_codeunits(new, 1), new)
        letters = pc.utf8_rtrim(words, _SIGNS)
        plain = pc.match_substring_regex(letters, _LETTERS).to_numpy(zero_copy_only=False)
        spaced = pc.binary_join_element_wise(pc.if_else(first, _LARGE[""], _LARGE[self.space]), pc.utf8_lower(letters) if self.lowered else letters, _LARGE[""]).filter(pa.array(plain)).dictionary_encode()
        at = np.flatnonzero(plain)
        n_signs = pc.subtract(pc.utf8_length(words), pc.utf8_length(letters)).to_numpy()
        signed = np.flatnonzero(plain & (n_signs > 0))
        tails = [u[-n:] for u, n in zip(new.take(pa.array(signed)).to_pylist(), n_signs[signed].tolist(), strict=True)]
        kinds = {t: i for i, t in enumerate(dict.fromkeys(tails))}
        others = [self._other(u) for u in new.filter(pa.array(~plain)).to_pylist()]
        head_ids, head_sizes = self._parts(spaced.dictionary.to_pylist())
        rest = [*map(self._sign, kinds), *(o or [] for o in others)]
        flat = np.concatenate([np.array(head_ids, dtype=np.uint32), np.fromiter(itertools.chain.from_iterable(rest), dtype=np.uint32)])
        pool_size = np.array([*head_sizes, *map(len, rest)], dtype=np.int64)
        n_heads = len(head_sizes)
        # Two rows of the pool for each unit: the head and the signs, or the unit as a whole and nothing.
        rows = np.full((len(new), 2), len(pool_size), dtype=np.int64)
        rows[at, 0] = spaced.indices.to_numpy()
        rows[signed, 1] = n_heads + np.fromiter(map(kinds.__getitem__, tails), dtype=np.int64, count=len(tails))
        rows[~plain, 0] = n_heads + len(kinds) + np.arange(len(others))
        pool_size = np.append(pool_size, 0)
        pool_start = np.cumsum(pool_size) - pool_size
        sizes = pool_size[rows].sum(axis=1)
        self.ids, before = np.concatenate([self.ids, flat[ragged(pool_start[rows].reshape(-1), pool_size[rows].reshape(-1))]]), len(self.ids)
        self.starts = np.concatenate([self.starts, before + np.cumsum(sizes) - sizes])
        sizes[np.flatnonzero(~plain)[np.fromiter((o is None for o in others), dtype=bool, count=len(others))]] = -1
        self.sizes = np.concatenate([self.sizes, sizes])
        self.known = pa.concat_arrays([self.known, new])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        flat, counts = self.encode_flat(texts)
        return np.split(flat, np.cumsum(counts)[:-1]) if texts else []

    def encode_flat(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other and each text's number of ids; end_id, if given, ends each text."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        apart = np.fromiter((any(x in t for x in self.apart) for t in texts), dtype=bool, count=len(texts))
        cut = pc.split_pattern(pa.array([self.FIRST + t.replace("\n", " \n \x00") if t and not a else self.LINE for t, a in zip(texts, apart.tolist(), strict=True)], pa.large_string()), " ")
        offsets = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        units = coded.dictionary
        at = self._places(units)[coded.indices.to_numpy()]
        sizes = self.sizes[at]
        empty = np.fromiter((not t for t in texts), dtype=bool, count=len(texts))
        sizes[offsets[:-1][empty | apart]] = 0  # stand-ins
        apart |= np.minimum.reduceat(sizes, offsets[:-1]) < 0
        if apart.any():
            sizes[np.repeat(apart, np.diff(offsets))] = 0
        counts = np.add.reduceat(sizes, offsets[:-1])
        flat = self.ids[ragged(self.starts[at], sizes)]
        if apart.any():
            own = np.split(flat, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(apart).tolist():
                own[i] = np.array(self._whole(texts[i]), dtype=np.uint32)
                counts[i] = len(own[i])
            flat = np.concatenate(own)
        if end_id is not None:
            flat = np.insert(flat, np.cumsum(counts), np.uint32(end_id))
            counts = counts + 1
        return flat, counts


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder a worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


class Forest:
    """Least node of each class of nodes joined so far, by union with path halving."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the pair joins two classes."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


FOREST_ROWS = 1_000_000


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (u, v) as pairs (node, least node of its class in this task), anew after each FOREST_ROWS rows."""
    forest = Forest()

    def settled() -> pa.RecordBatch:
        nodes = list(forest.parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], ["u", "v"])

    for b in batches:
        if len(forest.parent) > FOREST_ROWS:
            yield settled()
            forest = Forest()
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            forest.join(u, v)
    yield settled()


def components(edges: DataFrame, name: str = "components", scratch: Scratch | None = None) -> DataFrame:
    """Smallest node reachable from each node of edges(a, b): columns node, component (nodes without edges and smallest ones are absent).

    Each round first shrinks the pairs of every task to a forest, then links each node u to the least node p(u) beside
    it, links u's other smaller neighbours to p(u), and skips p(u) for p(p(u)). It ends when nothing changes: then every
    node has its root alone. Minima are summed up before they are shuffled; a node has at most one larger row a task in
    the first join; a root's many nodes meet in no aggregate, only in a join that Spark can split, both sides of which
    are written tables. All rounds are tables in the shared folder, deleted when the next one is written; the last one goes with `scratch`,
    if one is given.
    """
    keep = scratch.save if scratch else saved
    with Scratch(edges.sparkSession) as own:
        e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        held: list[DataFrame] = []
        while True:
            pairs = own.save(e.mapInArrow(_forests, "u long, v long"), name)
            least = own.save(pairs.groupBy("u").agg(F.min("v").alias("p")), name)
            extra = pairs.join(least, "u").where("v <> p").select(F.greatest("v", "p").alias("u"), F.least("v", "p").alias("v"), F.lit(True).alias("changed"))
            jump = least.join(least.select(F.col("u").alias("p"), F.col("p").alias("pp")), "p", "left").select("u", F.coalesce("pp", "p").alias("v"), F.col("pp").isNotNull().alias("changed"))
            step = jump.unionByName(extra)
            after = own.save(step, name)
            own.drop(pairs, least, *held)
            held = [after]
            if after.where("changed").isEmpty():
                return keep(after.select(F.col("u").alias("node"), F.col("v").alias("component")), name)
            e = after.select("u", "v")
