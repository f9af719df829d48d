"""Prompt features, z-scores fitted on one split, and composed complexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.scores import finite

STRUCTURAL = ("prompt_token_len", "question_token_len", "mean_option_token_len", "std_option_token_len", "question_option_ratio", "mattr", "compression_ratio")
GEOMETRY = ("centroid_distance", "lof_score")
LINGUISTIC = ("n_requirements", "reasoning_depth_score", "multihop_score", "domain_breadth", "n_question_marks", "n_sentences")


def prompt_features(rows: DataFrame, prompt: str = "prompt", compression: bool = True) -> DataFrame:
    """rows with structural, linguistic_cues and task_form structs; tokens are made once and shared."""
    p = F.col(prompt)
    base = rows.withColumns({"__q": T.question(p), "__opts": T.option_texts(p), "__toks": T.words(p), "__lower": F.lower(p)})
    base = base.withColumns({"__qtoks": T.words(F.col("__q")), "__qlower": F.lower("__q"), "__lens": F.transform("__opts", lambda o: F.size(T.words(o)).cast("double"))})
    n_opts, total = F.size("__lens"), F.aggregate("__lens", F.lit(0.0), lambda a, x: a + x)
    mean = F.when(n_opts > 0, total / F.greatest(n_opts, F.lit(1))).otherwise(F.lit(0.0))
    square = F.aggregate("__lens", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    q_len = F.size("__qtoks").cast("double")
    structural = [
        F.size("__toks").cast("double").alias("prompt_token_len"), q_len.alias("question_token_len"), mean.alias("mean_option_token_len"),
        F.when(n_opts > 1, F.sqrt(square / F.greatest(n_opts, F.lit(1)))).otherwise(F.lit(0.0)).alias("std_option_token_len"),
        F.when(total > 0, q_len / F.when(total > 0, total).otherwise(F.lit(1.0))).otherwise(q_len).alias("question_option_ratio"),
        T.mattr(F.col("__toks")).alias("mattr"), (T.compression_ratio(p) if compression else F.lit(None).cast("double")).alias("compression_ratio"),
    ]
    cues = [
        T.requirements(p), T.bloom_depth(F.col("__qtoks"), F.col("__qlower")), T.hits(L.MULTIHOP, F.col("__qlower")), T.domain_breadth(F.col("__lower")), T.occurrences(p, "?"), T.sentences(F.col("__q")),
    ]
    out = base.withColumns({"structural": F.struct(*structural), "linguistic_cues": F.struct(*[c.cast("double").alias(n) for n, c in zip(LINGUISTIC, cues, strict=True)])})
    return out.drop("__q", "__opts", "__toks", "__lower", "__qtoks", "__qlower", "__lens")


def task_form(rows: DataFrame, prompt: str = "prompt") -> DataFrame:
    """rows with is_mc (0 or 1) and n_choices, from the given count or else the prompt's option lines."""
    is_mc = F.coalesce(F.col("task_type"), F.lit("")).endswith("_mc")
    given = F.coalesce(F.col("n_choices"), F.lit(0)) if "n_choices" in rows.columns else F.lit(0)
    return rows.withColumns({"is_mc": is_mc.cast("int"), "n_choices": F.when(is_mc & (given == 0), F.size(T.option_labels(F.col(prompt)))).otherwise(given)})


def flattened(rows: DataFrame, key: str, blocks: dict[str, tuple[str, ...]]) -> DataFrame:
    """(key, feature, value): finite numbers of the blocks, named block.feature."""
    pairs = F.array(*[F.struct(F.lit(f"{b}.{f}").alias("feature"), F.col(f"{b}.{f}").cast("double").alias("value")) for b, fs in blocks.items() for f in fs])
    return rows.select(key, F.explode(pairs).alias("x")).select(key, "x.*").where(finite(F.col("value")))


def zstats(flat: DataFrame, floor: float = 0.0) -> DataFrame:
    """(feature, mean, std) of finite values; a population deviation of at most `floor`, or of one value, counts as 1."""
    stats = flat.where(finite(F.col("value"))).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return stats.withColumn("std", F.when(F.col("std") > floor, F.col("std")).otherwise(F.lit(1.0)))


def block_zstats(rows: DataFrame, blocks: dict[str, tuple[str, ...]], floor: float = 0.0) -> DataFrame:
    """zstats of all numbers of the blocks: one row of aggregates, then a row for each feature that has a finite value."""
    names = [(b, f) for b, fs in blocks.items() for f in fs]
    value = lambda b, f: F.when(finite(F.col(f"{b}.{f}").cast("double")), F.col(f"{b}.{f}").cast("double"))
    one = rows.agg(*[F.struct(F.avg(value(b, f)).alias("mean"), F.stddev_pop(value(b, f)).alias("std")).alias(f"s{i}") for i, (b, f) in enumerate(names)])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(f"{b}.{f}").alias("feature"), F.col(f"s{i}.mean").alias("mean"), F.col(f"s{i}.std").alias("std")) for i, (b, f) in enumerate(names)])).alias("x")).select("x.*")
    return long.where(F.col("mean").isNotNull()).withColumn("std", F.when(F.col("std") > floor, F.col("std")).otherwise(F.lit(1.0)))


def zscored(flat: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """(key, feature, z) for the features that the statistics know."""
    return flat.join(stats, "feature").select(key, "feature", ((F.col("value") - F.col("mean")) / F.col("std")).alias("z"))


def composed(z: DataFrame, key: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(key, C_length, C_density, C_atypical, C_linguistic, C_query) from (key, feature, z); a missing z counts as 0."""
    weights = weights or L.COMPLEXITY_WEIGHTS
    cues = [f"linguistic_cues.{f}" for f in LINGUISTIC if f != "n_question_marks"]
    one = lambda f: F.coalesce(F.max(F.when(F.col("feature") == f, F.col("z"))), F.lit(0.0))
    agg = z.groupBy(key).agg(
        one("structural.prompt_token_len").alias("C_length"), (one("structural.mattr") - one("structural.compression_ratio")).alias("C_density"),
        (0.5 * one("embedding_geometry.centroid_distance") + 0.5 * one("embedding_geometry.lof_score")).alias("C_atypical"), F.coalesce(F.avg(F.when(F.col("feature").isin(*cues), F.col("z"))), F.lit(0.0)).alias("C_linguistic"),
    )
    total = sum(weights.values()) or 1.0
    query: Column = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)) / total
    return agg.withColumn("C_query", query)
