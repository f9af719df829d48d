"""Language by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Texts are cut into stretches of STRETCH bytes; all of them are read, and both directions start anew in each. Every
position gets language probabilities from the two hidden states around it; a document's probabilities are the mean
over all its positions.

Training takes a bounded sample: at most `max_docs` labelled documents outside the held-out fold, in the order of a
hash of the id and the same number for each language, and up to STRETCHES_A_DOC stretches of each, evenly spread. The
languages are the `max_langs` most frequent ones. Executors cut the stretches, so that the driver gets at most
max_docs * STRETCHES_A_DOC * STRETCH bytes of text.

Defined results: null text, or text without a letter, is `und` with score 0; null langs teach nothing; without a
learned language all texts are `und`; repeated rows get equal results and teach once; a null doc_id is an id like
others; empty tables give empty results; other columns are passed through, one that has the name of `out` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, row_key

HIDDEN = 6
STRETCH = 64
BATCH = 2048
MAX_DOCS = 2400
MAX_LANGS = 100
STRETCHES_A_DOC = 4
EPOCHS = 5
LEAST_STEPS = 120
_LETTER = re.compile(r"[^\W\d_]")
PAD = 256
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


class BiGRU:
    """Parameters: per direction the input table (257 x 3H: update, reset, candidate) and the recurrent matrix, then the output layer."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.h = langs, hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"E{d}"] = rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)
            self.p[f"U{d}"] = rng.normal(0, 0.4, (hidden, 3 * hidden)).astype(np.float32)
        self.p["V"] = rng.normal(0, 0.4, (2 * hidden, len(langs))).astype(np.float32)
        self.p["c"] = np.zeros(len(langs), np.float32)

    def _steps(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (T, B, H) of one direction; x is (T, B). Gates use tanh: sigmoid(a) = (1 + tanh(a / 2)) / 2."""
        h2, n = 2 * self.h, x.shape[1]
        half = np.ones(3 * self.h, np.float32)
        half[:h2] = 0.5
        e, u = self.p[f"E{d}"] * half, self.p[f"U{d}"] * half
        u_gates, u_new = np.ascontiguousarray(u[:, :h2]), np.ascontiguousarray(u[:, h2:])
        out = np.empty((len(x), n, self.h), np.float32)
        h = np.zeros((n, self.h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g = e[x[t]]
            gates = h @ u_gates
            gates += g[:, :h2]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, : self.h], gates[:, self.h :]
            hu = h @ u_new
            new = r * hu
            new += g[:, h2:]
            np.tanh(new, out=new)
            before = h
            h = before - new
            h *= z
            h += new
            out[t] = h
            if keep is not None:
                keep.append((t, before, z, r, hu, new))
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities (T, B, L) of every position of x (T, B)."""
        both = np.concatenate([self._steps(x, "f"), self._steps(x, "b")], axis=2)
        logits = both.reshape(-1, 2 * self.h) @ self.p["V"] + self.p["c"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.reshape(*x.shape, -1)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the positions that are no padding, and its gradients by backpropagation through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self._steps(x, d, kept[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        logits = both @ self.p["V"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        real = (x != PAD).astype(np.float32)
        total = max(real.sum(), 1)
        own = np.take_along_axis(p, np.broadcast_to(y, x.shape)[..., None], axis=2)[..., 0]
        loss = float(-(np.log(own + 1e-9) * real).sum() / total)
        delta = p
        delta -= np.eye(len(self.langs), dtype=np.float32)[y][None]
        delta *= (real / total)[..., None]
        grads = {"V": np.einsum("tbh,tbl->hl", both, delta), "c": delta.sum(axis=(0, 1))}
        back = delta @ self.p["V"].T
        h = self.h
        for d in "fb":
            e_grad = np.zeros_like(self.p[f"E{d}"])
            u = self.p[f"U{d}"]
            u_grad = np.zeros_like(u)
            carry = np.zeros((x.shape[1], h), np.float32)
            direct = back[..., :h] if d == "f" else back[..., h:]
            for t, before, z, r, hu, new in reversed(kept[d]):
                dh = direct[t] + carry
                dz = dh * (before - new) * z * (1 - z)
                dn = dh * (1 - z) * (1 - new * new)
                dr = dn * hu * r * (1 - r)
                da = np.concatenate([dz, dr, dn * r], axis=1)
                carry = dh * z + da @ u.T
                u_grad += before.T @ da
                da[:, 2 * h :] = dn
                order = np.argsort(x[t], kind="stable")
                codes = x[t][order]
                cuts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
                e_grad[codes[cuts]] += np.add.reduceat(da[order], cuts, axis=0)
            grads[f"E{d}"], grads[f"U{d}"] = e_grad, u_grad
        return loss, grads

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam over stretches x (N, T) of languages y (N), at least LEAST_STEPS steps; the loss of each epoch."""
        epochs = max(epochs, -(-LEAST_STEPS // -(-len(x) // batch)))
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, losses = 0, []
        n_steps = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order, total = rng.permutation(len(x)), 0.0
            for at in range(0, len(x), batch):
                pick = order[at : at + batch]
                loss, grads = self.gradients(np.ascontiguousarray(x[pick].T), y[pick])
                total += loss * len(pick)
                step += 1
                now = rate * (1 - 0.9 * step / n_steps)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(total / len(x))
        return losses

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean position probabilities (N, L) of whole texts; zeros for empty ones."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        sums = np.zeros((len(texts), len(self.langs)))
        pieces = -(-sizes // STRETCH)
        room = np.full(int(pieces.sum()) * STRETCH, PAD, np.uint16)
        first = (np.cumsum(pieces) - pieces) * STRETCH
        for t, at in zip(texts, first.tolist(), strict=True):
            room[at : at + len(t)] = np.frombuffer(t, np.uint8)
        x = room.reshape(-1, STRETCH)
        owner = np.repeat(np.arange(len(texts)), pieces)
        for at in range(0, len(x), BATCH):
            part = np.ascontiguousarray(x[at : at + BATCH].T)
            p = self.positions(part)
            p[part == PAD] = 0
            np.add.at(sums, owner[at : at + BATCH], p.sum(axis=0))
        return sums / np.maximum(sizes, 1)[:, None]


def stretches(text: bytes, most: int) -> np.ndarray:
    """Up to `most` evenly spread stretches of a text, padded."""
    n = -(-len(text) // STRETCH)
    at = np.unique(np.linspace(0, n - 1, min(n, most)).astype(int))
    out = np.full((len(at), STRETCH), PAD, np.uint16)
    for row, k in zip(out, at.tolist(), strict=True):
        piece = np.frombuffer(text[k * STRETCH : (k + 1) * STRETCH], np.uint8)
        row[: len(piece)] = piece
    return out


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _stretches_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [x.astype("<u2").tobytes() for x in stretches(t.encode(), STRETCHES_A_DOC)])


def fit_on(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, held_out: int = 2, max_docs: int = MAX_DOCS, max_langs: int = MAX_LANGS) -> BiGRU | None:
    """A network for the langs of docs. None without a labelled text."""
    rows = docs.where((fold(F.col(doc_id), folds) != held_out) & F.col(lang).isNotNull() & (F.col(lang) != "und") & (F.length(F.col(text)) > 0))
    keys = rows.select(F.col(lang).alias("y"), *row_key(doc_id, text))
    # At most max_langs rows.
    langs = sorted(r["y"] for r in keys.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "y").limit(max_langs).collect())
    if not langs:
        return None
    first = Window.partitionBy("y").orderBy(F.xxhash64("key_id"), "key_id", "key_text")
    # Spark keeps the first rows of each language in every task before it shuffles them; at most max_docs are left.
    picked = keys.where(F.col("y").isin(langs)).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= max(1, max_docs // len(langs))).drop("rank").distinct()
    cut = rows.select(F.col(lang).alias("y"), *row_key(doc_id, text), F.col(text).alias("t")).join(F.broadcast(picked), ["y", "key_id", "key_text"], "left_semi").select("y", "key_id", "key_text", _stretches_of("t").alias("s"))
    sample = cut.dropDuplicates(["y", "key_id", "key_text"]).orderBy("y", F.xxhash64("key_id"), "key_id", "key_text").collect()
    x = np.stack([np.frombuffer(s, "<u2") for r in sample for s in r["s"]])
    y = np.array([langs.index(r["y"]) for r in sample for _ in r["s"]])
    net = BiGRU(langs)
    net.train(x, y)
    return net


def predict(docs: DataFrame, net: BiGRU | None, text: str = "text", out: str = "language") -> DataFrame:
    """docs with `out`: struct(lang, score)."""

    @F.pandas_udf(RESULT)
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            known = [bool(net) and bool(t) and _LETTER.search(t) is not None for t in texts]
            data = [t.encode() if k else b"" for t, k in zip(texts, known, strict=True)]
            langs, scores = [], []
            p = net.documents(data) if net else np.zeros((len(data), 1))
            for k, row in zip(known, p, strict=True):
                best = int(row.argmax())
                langs.append(net.langs[best] if k else "und")
                scores.append(float(min(max(row[best], 0.0), 1.0)) if k else 0.0)
            yield pd.DataFrame({"lang": langs, "score": scores})

    return docs.withColumn(out, labelled(F.col(text)))
