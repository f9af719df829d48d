"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Fitting. The examples are a bounded sample of labelled rows outside the held-out fold (at most `max_examples`, half of
them for each label, in the order of a hash of the id). All their words are terms. A word's weight in a text is
(1 + log count) * idf * relevance: idf over the examples, relevance the root of the word's chi-squared between the
labels (at least LEAST_RELEVANCE), the usual term weighting of TF-IDF for classes. Texts are unit vectors of these
weights over all terms.

Index. Examples are put in order by their language (as k-means tells it from the presence of the most frequent words),
label and heaviest term, so that like ones share a block of BLOCK examples. Postings are stored by block and term, with each
term's largest weight in each block. The DENSE most frequent terms have their postings in full, zeros included.

Search. A block's bound is the sum over the text's terms of its weight times the block's maximum. For BATCH texts
together, first the FIRST_BLOCKS blocks of the largest bounds are scored, then all blocks whose bounds reach the k-th
best score so far. Block scores are single-precision sums, a matrix product for dense terms and a sum over lists for
the others; examples within SLACK of the k-th best are scored again in double precision, so the neighbours are exact;
ties go to the lower example number.

Scores. Neighbours vote with their squared cosine and a weight that undoes the sample's balance; a logistic curve
fitted on leave-one-out votes of the sample turns the vote into a probability. Texts that share no word with any example,
empty and null ones among them, have no neighbours and get the rate of label 1.

Defined results: null text scores as empty; null labels teach nothing; of several texts under one id the least one is
the example; without examples, or with one label only, the score is the rate of label 1 (0 without examples); repeated
rows get equal results; empty tables give empty results; other columns are passed through, one that has the name of
`out` is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, give_back, ragged

MAX_EXAMPLES = 4000
NEIGHBOURS = 15
BLOCK = 256
BATCH = 64
TEXTS = 512
DENSE = 384
LEAST_RELEVANCE = 0.01
FIRST_BLOCKS = 2
#: Far above the error of a single-precision sum of products of unit vectors.
SLACK = 1e-4
_WORD = re.compile(r"[^\W\d_]+")
RESULT = "struct<score: double, evidence: array<struct<example: bigint, cosine: double, label: int>>>"


def words_of(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


@dataclass
class BlockMaxIndex:
    """Unit vectors of examples as postings by block and term, block maxima and exact top-k search."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    n: int = 0
    example: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    term: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Made from the postings where they are first needed.
    tables: SearchTables | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None}

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit weights of a text's words; words that are no terms are left out."""
        known = self.vocabulary
        words = [t for t in counts if t in known]
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        return self.weighted(np.array([known[t] for t in words], dtype=np.int64), np.array([counts[t] for t in words], dtype=np.float64))

    def weighted(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(n)) * self.weight[at]
        return at, w / (np.sqrt(w @ w) or 1)

    def add_all(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.n = len(vectors)
        self.example = np.repeat(np.arange(self.n, dtype=np.int32), [len(at) for at, _ in vectors])
        self.term, self.value = np.concatenate([at for at, _ in vectors]).astype(np.int32), np.concatenate([w for _, w in vectors])

    def top(self, at: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Example numbers and cosines of the k nearest (cosine over 0), best first."""
        return self.top_all([(at, w)], k)[0]

    def top_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """top() of each vector; skip: an example for each that is left out."""
        if self.tables is None:
            self.tables = SearchTables(self)
        out = []
        for i in range(0, len(vectors), BATCH):
            out += self.tables.top(vectors[i : i + BATCH], k, None if skip is None else skip[i : i + BATCH])
        return out


class SearchTables:
    def __init__(self, index: BlockMaxIndex):
        self.n, self.terms = index.n, len(index.vocabulary)
        self.blocks = -(-self.n // BLOCK)
        # By example, for exact scores.
        self.row = np.searchsorted(index.example, np.arange(self.n + 1))
        self.row_term, self.row_value = index.term, index.value
        # By block and term.
        df = np.bincount(index.term, minlength=self.terms)
        often = np.argsort(-df, kind="stable")[:DENSE]
        self.dense_of = np.full(self.terms, -1, dtype=np.int32)
        self.dense_of[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.n), np.float32)
        self.maxima = np.zeros((self.terms, self.blocks), np.float32)
        self.begin = np.zeros((self.blocks, self.terms + 1), np.int32)
        example, value, size = [], [], 0
        for b in range(self.blocks):
            own = slice(self.row[b * BLOCK], self.row[min((b + 1) * BLOCK, self.n)])
            order = np.lexsort((index.example[own], index.term[own]))
            e, t, v = index.example[own][order], index.term[own][order], index.value[own][order].astype(np.float32)
            np.maximum.at(self.maxima[:, b], t, v)
            full = self.dense_of[t] >= 0
            self.dense[self.dense_of[t[full]], e[full]] = v[full]
            self.begin[b] = size + np.searchsorted(t[~full], np.arange(self.terms + 1))
            example.append(e[~full])
            value.append(v[~full])
            size += len(example[-1])
        self.example, self.value = np.concatenate(example), np.concatenate(value)
        self.query = np.zeros(self.terms)

    def top(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, skip: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        m = len(vectors)
        bounds = np.stack([w.astype(np.float32) @ self.maxima[at] for at, w in vectors]) * np.float32(1.0001)
        owner = np.repeat(np.arange(m), [len(at) for at, _ in vectors])
        at, w = (np.concatenate([v[x] for v in vectors]) for x in (0, 1))
        full = self.dense_of[at] >= 0
        dense = np.zeros((m, len(self.dense)), np.float32)
        dense[owner[full], self.dense_of[at[full]]] = w[full]
        owner, at, w = owner[~full], at[~full], w[~full].astype(np.float32)
        scores = np.full((m, self.n), -1, dtype=np.float32)

        def visit(wanted: np.ndarray) -> np.ndarray:
            """Scores the wanted blocks; the k-th best score of each text so far, 0 at least."""
            place = np.empty(m, dtype=np.int64)
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                rows, lo, hi = np.flatnonzero(wanted[:, b]), b * BLOCK, min((b + 1) * BLOCK, self.n)
                place.fill(-1)
                place[rows] = np.arange(len(rows))
                lists = np.flatnonzero(place[owner] >= 0)
                begin = self.begin[b][at[lists]]
                number = self.begin[b][at[lists] + 1] - begin
                some = number > 0
                lists, begin, number = lists[some], begin[some], number[some]
                posts = ragged(begin, number)
                cell = np.repeat(place[owner[lists]] * (hi - lo) - lo, number) + self.example[posts]
                sums = np.bincount(cell, weights=self.value[posts] * np.repeat(w[lists], number), minlength=len(rows) * (hi - lo))
                scores[rows, lo:hi] = dense[rows] @ self.dense[:, lo:hi] + sums.reshape(len(rows), hi - lo)
            if skip is not None:
                scores[np.arange(m), skip] = -1
            return np.maximum(np.partition(scores, self.n - k, axis=1)[:, self.n - k], 0) if self.n > k else np.zeros(m, np.float32)

        best = np.zeros((m, self.blocks), dtype=bool)
        np.put_along_axis(best, np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST_BLOCKS], True, axis=1)
        best &= bounds > 0
        least = visit(best)
        least = visit((bounds > 0) & (bounds + SLACK >= least[:, None]) & ~best)
        return [self._exact(v, np.flatnonzero(s > max(x - SLACK, 0)), k) for v, s, x in zip(vectors, scores, least.tolist(), strict=True)]

    def _exact(self, vector: tuple[np.ndarray, np.ndarray], who: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if not len(who):
            return who, np.zeros(0)
        at, w = vector
        self.query[at] = w
        number = self.row[who + 1] - self.row[who]
        posts = ragged(self.row[who], number)
        cosines = np.round(np.add.reduceat(self.query[self.row_term[posts]] * self.row_value[posts], np.cumsum(number) - number), 12)
        self.query[at] = 0
        cut = np.lexsort((who, -cosines))[:k]
        return who[cut], cosines[cut]


def language_of(vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, groups: int = 8, words: int = 64, rounds: int = 10) -> np.ndarray:
    """A group for each vector, by k-means on the presence of the most frequent terms."""
    at = np.concatenate([v[0] for v in vectors])
    often = np.argsort(-np.bincount(at, minlength=terms), kind="stable")[:words]
    place = np.full(terms, -1)
    place[often] = np.arange(len(often))
    x = np.zeros((len(vectors), len(often)))
    of = np.repeat(np.arange(len(vectors)), [len(v[0]) for v in vectors])
    seen = place[at] >= 0
    x[of[seen], place[at[seen]]] = 1
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1)
    centers = x[np.linspace(0, len(x) - 1, groups).astype(int)]
    for _ in range(rounds):
        group = (x @ centers.T).argmax(axis=1)
        centers = np.stack([x[group == g].mean(axis=0) if (group == g).any() else c for g, c in enumerate(centers)])
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-9)
    return group


@dataclass
class ToxicityModel:
    index: BlockMaxIndex
    labels: np.ndarray
    ids: np.ndarray
    weights: tuple[float, float] = (1.0, 1.0)
    curve: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None
    base: float = 0.0

    def vote(self, who: np.ndarray, cosines: np.ndarray) -> float:
        bad = self.labels[who] == 1
        w = cosines**2 * np.where(bad, self.weights[1], self.weights[0])
        return float((w[bad].sum() + 0.0001) / (w.sum() + 0.0002))

    def calibrated(self, vote: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * np.log(vote / (1 - vote)) + b, -30, 30))))

    def nearest(self, texts: list[str]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Score of each text, and numbers and cosines of the examples behind it."""
        if self.constant is not None:
            return [(self.constant, np.zeros(0, np.int64), np.zeros(0))] * len(texts)
        found = self.index.top_all([self.index.vector(words_of(t)) for t in texts], NEIGHBOURS)
        return [(self.calibrated(self.vote(who, cosines)) if len(who) else self.base, who, cosines) for who, cosines in found]

    def score(self, text: str) -> tuple[float, list[tuple[int, float, int]]]:
        score, who, cosines = self.nearest([text])[0]
        return score, [(int(self.ids[i]), round(float(c), 6), int(self.labels[i])) for i, c in zip(who.tolist(), cosines, strict=True)]


def fit(ids: list[int], texts: list[str], labels: list[int], base_rate: float) -> ToxicityModel:
    """Model of the given examples; base_rate is the rate of label 1 among all labelled rows."""
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(BlockMaxIndex(), y, np.array(ids, dtype=np.int64), constant=float(y.mean()) if len(y) else 0.0)
    vocabulary: dict[str, int] = {}
    bags = []
    for t in texts:
        counts = words_of(t)
        bags.append((np.array([vocabulary.setdefault(w, len(vocabulary)) for w in counts], dtype=np.int64), np.array(list(counts.values()), dtype=np.float64)))
    terms, n1, n0 = len(vocabulary), int(y.sum()), int(len(y) - y.sum())
    df, a = (np.bincount(np.concatenate([np.zeros(0, np.int64), *(at for (at, _), label in zip(bags, labels, strict=True) if label >= least)]), minlength=terms).astype(float) for least in (0, 1))
    b = df - a
    chi2 = (a * (n0 - b) - b * (n1 - a)) ** 2 * (n1 + n0) / np.maximum(df * (n1 + n0 - df) * n1 * n0, 1)
    index = BlockMaxIndex(vocabulary, (np.log((1 + len(y)) / (1 + df)) + 1) * np.maximum(np.sqrt(chi2), LEAST_RELEVANCE))
    vectors = [index.weighted(at, n) for at, n in bags]
    del bags
    heaviest = [int(at[w.argmax()]) if len(at) else -1 for at, w in vectors]
    language = language_of(vectors, terms)
    order = sorted(range(len(y)), key=lambda i: (language[i], labels[i], heaviest[i], i))
    vectors = [vectors[i] for i in order]
    index.add_all(vectors)
    y = y[order]
    model = ToxicityModel(index, y, np.array(ids, dtype=np.int64)[order], base=base_rate)
    model.weights = ((1 - base_rate) * len(y) / n0, base_rate * len(y) / n1)
    found = [(i, *x) for i, x in enumerate(index.top_all(vectors, NEIGHBOURS, skip=np.arange(len(y))))]
    votes = np.array([model.vote(who, cosines) for _, who, cosines in found if len(who)])
    own = np.array([i for i, who, _ in found if len(who)], dtype=np.int64)
    model.curve = _logistic(np.log(votes / (1 - votes)), y[own].astype(float), np.array(model.weights)[y[own]])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, held near (1, 0) by a small ridge."""
    a, b = 1.0, 0.0
    if not len(x):
        return a, b
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (p - y) * x).sum() + (a - 1), (w * (p - y)).sum() + b])
        s = w * p * (1 - p)
        h = np.array([[(s * x * x).sum() + 1, (s * x).sum()], [(s * x).sum(), s.sum() + 1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def fit_on(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, held_out: int = 0, max_examples: int = MAX_EXAMPLES) -> ToxicityModel:
    """Model of the labelled rows of docs outside the held-out fold; the driver gets at most max_examples texts."""
    rows = labels.select(F.col(doc_id).cast("long").alias("i"), F.col(label).cast("int").alias("y")).where((fold(F.col(doc_id), folds) != held_out) & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    once = rows.groupBy("i").agg(F.max("y").alias("y"))
    rate = once.agg(F.avg("y")).first()[0] or 0.0
    half = max_examples // 2
    picked = [once.where(F.col("y") == v).orderBy(F.xxhash64("i"), "i").limit(half) for v in (0, 1)]
    # At most max_examples rows of two numbers: a size that does not grow.
    few = F.broadcast(picked[0].unionByName(picked[1]))
    found = docs.select(F.col(doc_id).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(few, "i").groupBy("i", "y").agg(F.min("t").alias("t")).orderBy(F.xxhash64("i"), "i").collect()
    return fit([r["i"] for r in found], [r["t"] for r in found], [r["y"] for r in found], float(rate))


def score_docs(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with `out`: struct(score, evidence: nearest examples with cosine and label)."""

    @F.arrow_udf(RESULT)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows: list[tuple[float, np.ndarray, np.ndarray]] = []
            for i in range(0, len(texts), TEXTS):
                some = [t or "" for t in texts.slice(i, TEXTS).to_pylist()]
                once = list(dict.fromkeys(some))  # copies are searched once
                found = dict(zip(once, model.nearest(once), strict=True))
                rows += [found[t] for t in some]
            who = np.concatenate([np.zeros(0, np.int64), *(r[1] for r in rows)])
            evidence = pa.StructArray.from_arrays([pa.array(model.ids[who], pa.int64()), pa.array(np.round(np.concatenate([np.zeros(0), *(r[2] for r in rows)]), 6)), pa.array(model.labels[who], pa.int32())], ["example", "cosine", "label"])
            ends = np.cumsum([0, *(len(r[1]) for r in rows)])
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), evidence)], ["score", "evidence"])
        give_back()

    return docs.withColumn(out, scored(F.col(text)))
