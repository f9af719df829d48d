"""Checks of probe tables against their corpus, and the analysis tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..plans.routing import unpivoted
from .ranking import auroc, sliced

# Signals of the second analysis table with family and direction.
SIGNALS = [("entropy", "H", 1), ("entropy", "perplexity_H", 1), ("confidence", "p_max", -1), ("confidence", "surprisal", 1), ("confidence", "inv_p_max", 1), ("margin", "margin", -1), ("top2", "top2_mass", -1)]


def issues(signals: DataFrame, corpus: DataFrame, model_role: str, backend: str | None = None, manifest_count: int | None = None) -> DataFrame:
    """(check, detail, n) for what is wrong with the probes of a model role; an empty result is a sound table."""
    spark = signals.sparkSession
    rows = signals.where(F.col("model_role") == model_role)
    counts = rows.agg(F.count("*").alias("got")).crossJoin(corpus.agg(F.count("*").alias("expected")))
    line = lambda df, check, detail, n: df.select(F.lit(check).alias("check"), detail.cast("string").alias("detail"), n.cast("long").alias("n"))
    no_rows = line(counts.where("got = 0"), "no_rows", F.lit(model_role), F.col("got"))
    total = line(counts.where("got <> expected"), "row_count", F.col("expected"), F.col("got"))
    by_source = corpus.groupBy("source").agg(F.count("*").alias("e")).join(rows.groupBy("source").agg(F.count("*").alias("g")), "source", "left").withColumn("g", F.coalesce("g", F.lit(0)))
    source = line(by_source.where("g <> e"), "source_count", F.concat_ws(": ", "source", F.col("e").cast("string")), F.col("g"))
    twice = line(rows.groupBy("query_id").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("c")).where("c > 0"), "duplicate_ids", F.lit(""), F.col("c"))
    missing = line(corpus.join(rows, "query_id", "left_anti").agg(F.count("*").alias("c")).where("c > 0"), "missing_ids", F.lit(""), F.col("c"))
    unknown = line(rows.join(corpus, "query_id", "left_anti").agg(F.count("*").alias("c")).where("c > 0"), "unknown_ids", F.lit(""), F.col("c"))
    empty = line(rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("H", "p_max", "pred")]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("c")) for c in ("H", "p_max", "pred")])).alias("x")).select("x.*").where("c > 0"), "missing_field", F.col("f"), F.col("c"))
    uniform = line(rows.where("probs is not null and size(array_distinct(map_values(probs))) = 1 and size(probs) > 1").agg(F.count("*").alias("c")).where("c > 0"), "uniform_probs", F.lit(""), F.col("c"))
    out = no_rows
    for more in (total, source, twice, missing, unknown, empty, uniform):
        out = out.unionByName(more)
    stated = []
    if backend == "mock":
        stated.append(("mock_backend", backend, 1))
    if stated:
        out = out.unionByName(spark.createDataFrame(stated, "check string, detail string, n long"))
    if manifest_count is not None:
        out = out.unionByName(line(counts.where(F.col("got") != manifest_count), "manifest_count", F.lit(manifest_count), F.col("got")))
    return out


def model_roles(signals: DataFrame) -> DataFrame:
    """(model_role, n): the model roles in a table of probes."""
    return signals.groupBy("model_role").agg(F.count("*").alias("n"))


def signal_auroc(rows: DataFrame) -> DataFrame:
    """(slice, family, signal, direction, n, n_wrong, auroc, representative): each signal against a wrong weak answer; slices of one class or under two rows are left out."""
    names = [s for _, s, _ in SIGNALS] + (["U"] if "U" in rows.columns else [])
    spec = SIGNALS + ([("paraphrase", "U", 1)] if "U" in rows.columns else [])
    table = F.broadcast(rows.sparkSession.createDataFrame([(s, f, d, s in L.PSI or s == "U") for f, s, d in spec], "signal string, family string, direction int, representative boolean"))
    long = unpivoted(sliced(rows), ["slice", "weak_wrong"], names).withColumnRenamed("feature", "signal").join(table, "signal")
    sizes = sliced(rows).groupBy("slice").agg(F.count("*").alias("n"), F.count_if("weak_wrong").alias("n_wrong")).where("n >= 2 and n_wrong > 0 and n_wrong < n")
    got = auroc(long, ["slice", "signal"], F.col("weak_wrong"), F.col("value") * F.col("direction")).select("slice", "signal", "auroc")
    return got.join(sizes, "slice").join(table, "signal").select("slice", "family", "signal", "direction", "n", "n_wrong", "auroc", "representative")


def join_check(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("joined"), F.count_if("has_strong").alias("with_strong"))
