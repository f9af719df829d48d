"""Embedding geometry fitted on one split: centroid, principal components, exact neighbours, local outlier factor."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L

BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, n).otherwise(F.lit(1.0))


def centroid(vectors: DataFrame, vector: str = "v") -> DataFrame:
    """One row: the mean vector."""
    means = vectors.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    return means.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def centroid_distance(vectors: DataFrame, center: DataFrame, vector: str = "v") -> DataFrame:
    """vectors with 1 - cosine to the centroid (one row, as long as a vector)."""
    both = vectors.crossJoin(F.broadcast(center))
    return both.withColumn("centroid_distance", 1.0 - dot(F.col(vector), F.col("centroid")) / (norm(F.col(vector)) * norm(F.col("centroid")))).drop("centroid")


def principal_components(vectors: DataFrame, n: int = L.PCA_COMPONENTS, vector: str = "v") -> list[list[float]]:
    """Leading eigenvectors of the covariance; the largest entry of each is positive. The driver sees d x d sums only."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                x = np.stack(b[vector].to_numpy()).astype(float)
                x = np.hstack([x, np.ones((len(x), 1))])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"m": [total.reshape(-1).tolist()]})

    parts = vectors.select(vector).mapInPandas(sums, "m array<double>").select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    if not parts:
        return []
    d = int(round(len(parts) ** 0.5))
    m = np.array([r["x"] for r in parts]).reshape(d, d)
    count = m[-1, -1]
    mean = m[-1, :-1] / count
    cov = m[:-1, :-1] / count - np.outer(mean, mean)
    values, vectors_ = np.linalg.eigh(cov)
    top = vectors_[:, np.argsort(-values)][:, : min(n, int(count), d - 1)].T
    return [(c * np.sign(c[np.abs(c).argmax()])).tolist() for c in top]


def projected(vectors: DataFrame, components: list[list[float]], center: DataFrame, vector: str = "v") -> DataFrame:
    both = vectors.crossJoin(F.broadcast(center))
    moved = F.zip_with(F.col(vector), F.col("centroid"), lambda x, c: x - c)
    return both.withColumns({f"pc{i + 1}": dot(moved, F.array(*[F.lit(x) for x in c])) for i, c in enumerate(components)}).drop("centroid")


def neighbours(queries: DataFrame, fit: DataFrame, k: int, n_fit: int, key: str = "vec_id", vector: str = "v") -> DataFrame:
    """(key, neighbour, distance, rank): the k nearest rows of fit by cosine distance, ties by id.

    Exact search: its work is the product of both sides' rows. Both sides are cut into blocks, of fit BLOCK rows each; a
    pair of blocks is one matrix product that keeps its k best, and a window merges them. No side is broadcast.
    n_fit: rows of fit.
    """
    fit_blocks, kind = max(1, -(-n_fit // BLOCK)), queries.schema[key].dataType.simpleString()
    q = queries.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(max(8, fit_blocks))).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(fit_blocks - 1).cast("long"))).alias("fb"))
    f = fit.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(fit_blocks)).alias("fb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(8, fit_blocks) - 1).cast("long"))).alias("qb"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": left["id"].iloc[:0], "neighbour": right["id"].iloc[:0], "distance": pd.Series(dtype="float64")})
        a, b = (np.stack(x["v"].to_numpy()).astype(float) for x in (left, right))
        a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (a, b))
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        d = 1.0 - a @ b.T
        r = np.round(d, 12)
        take = min(k, d.shape[1])
        # All within the k-th least distance, so that ties are there to be told apart by id.
        row, col = np.nonzero((r <= np.partition(r, take - 1, axis=1)[:, take - 1 : take]) & np.isfinite(r))
        order = np.lexsort((others[col], r[row, col], row))
        row, col = row[order], col[order]
        first = np.searchsorted(row, np.arange(len(ids)))
        keep = np.arange(len(row)) - first[row] < take
        row, col = row[keep], col[keep]
        return pd.DataFrame({"id": ids[row], "neighbour": others[col], "distance": d[row, col]})

    pairs = q.groupBy("qb", "fb").cogroup(f.groupBy("qb", "fb")).applyInPandas(best, f"id {kind}, neighbour {kind}, distance double")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.round("distance", 12), "neighbour")))
    return ranked.where(F.col("rank") <= k).withColumnRenamed("id", key)


def knn_similarity(near: DataFrame, key: str = "vec_id") -> DataFrame:
    return near.groupBy(key).agg(F.avg(1.0 - F.col("distance")).alias("mean_knn_similarity"))


def outlier_factors(queries: DataFrame, fit: DataFrame, n_fit: int, k: int = L.KNN, key: str = "vec_id", vector: str = "v") -> DataFrame:
    """(key, lof, lof_score): the factor, and standardised by the fit rows' mean and deviation. A fit row's own density leaves itself out; scoring does not.

    The rows of fit are among the queries: one search for k + 1 neighbours serves both.
    """
    k = min(k, n_fit)
    searched = neighbours(queries, fit, k + 1, n_fit, key, vector)
    others = searched.where(F.col(key) != F.col("neighbour")).join(fit.select(key), key, "left_semi")
    own = others.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("rank"))).where(F.col("rank") <= k)
    reach_of = own.groupBy(key).agg(F.max("distance").alias("k_distance"))

    def density(near: DataFrame) -> DataFrame:
        reach = near.join(reach_of.select(F.col(key).alias("neighbour"), F.col("k_distance").alias("kd")), "neighbour")
        return reach.groupBy(key).agg((1.0 / (F.avg(F.greatest("kd", "distance")) + 1e-10)).alias("lrd"))

    fit_density = density(own)
    near = searched.where(F.col("rank") <= k)
    around = near.join(fit_density.select(F.col(key).alias("neighbour"), F.col("lrd").alias("n_lrd")), "neighbour").groupBy(key).agg(F.avg("n_lrd").alias("around"))
    raw = around.join(density(near), key).select(key, (F.col("around") / F.col("lrd")).alias("lof"))
    stats = raw.join(fit.select(key), key, "left_semi").agg(F.avg("lof").alias("m"), F.stddev_pop("lof").alias("s"))
    return raw.crossJoin(F.broadcast(stats)).select(key, "lof", ((F.col("lof") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(F.lit(1.0))).alias("lof_score"))


def fit_violations(used: DataFrame, rows: DataFrame, key: str = "query_id", role: str = "role") -> DataFrame:
    """(check, n): evaluation rows among those a transform was fitted on, and rows from outside the fit split; none is empty."""
    counts = lambda df, name: df.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(name).alias("check"), "n")
    return counts(used.join(rows.where(F.col(role) == "eval"), key, "left_semi"), "evaluation_rows").unionByName(counts(used.join(rows.where(F.col(role) == "fit"), key, "left_anti"), "outside_fit"))


def assert_fit_only(used: DataFrame, rows: DataFrame, key: str = "query_id", role: str = "role") -> None:
    """No evaluation row among the rows a transform was fitted on, and none from outside the fit split."""
    broken = {r["check"]: r["n"] for r in fit_violations(used, rows, key, role).collect()}
    if "evaluation_rows" in broken:
        raise ValueError("evaluation rows in a fitted transform")
    if broken:
        raise ValueError("rows outside the fit split in a fitted transform")


class HashingEncoder:
    """The stand-in for a sentence encoder: signed counts of hashed words as unit vectors. Any object with encode(list of texts) -> matrix takes its place."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, t in zip(out, texts, strict=True):
            for w in t.lower().split():
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                row[h % self.dim] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def encode_texts(rows: DataFrame, encoder: object, key: str = "query_id", text: str = "prompt", vector: str = "v") -> DataFrame:
    """(key, vector) of every row, by Arrow batches of the encoder."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], vector: list(np.asarray(encoder.encode(b[text].fillna("").tolist()), dtype=float))})

    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, `{vector}` array<double>")


def atypicality(vectors: DataFrame, fit: DataFrame, key: str = "query_id", vector: str = "v", k: int = L.KNN) -> DataFrame:
    """(key, embedding_geometry): distance from the fit centroid and standardised outlier factor of every row; fit is part of vectors."""
    far = centroid_distance(vectors, centroid(fit, vector), vector).select(key, "centroid_distance")
    odd = outlier_factors(vectors, fit, fit.count(), k, key, vector).select(key, "lof_score")
    return far.join(odd, key, "left").select(key, F.struct("centroid_distance", "lof_score").alias("embedding_geometry"))
