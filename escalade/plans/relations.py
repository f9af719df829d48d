"""Relations derived from the star-schema tables: prompts from documents, probes and features from embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from . import routing

LETTERS = ["A", "B", "C", "D"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def role_of(number: Column) -> Column:
    return F.when(number % 10 < 5, "fit").when(number % 10 == 5, "calib").otherwise("eval")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prompts, their quality label as the answer."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    gold = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").otherwise("unlabelled")
    rows = d.join(labels, "doc_id", "left")
    prompt = T.trim(F.col("text"))
    return rows.select(
        T.query_id(F.col("source"), F.col("lang"), F.lit("all"), F.col("doc_id")).alias("query_id"), "doc_id", "source", F.col("lang").alias("config"), F.lit("all").alias("hf_split"), role_of(F.col("doc_id")).alias("role"),
        prompt.alias("prompt"), gold.alias("gold"), T.text_hash(F.concat(prompt, F.lit("||"), gold)).alias("text_hash"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def probe_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prompt per vector: ids, kind, gold, the letter probabilities of the weak and the strong model, five features, latencies."""
    v = F.col("v")
    weak = F.slice(v, 1, 4)
    strong = F.zip_with(F.slice(v, 5, 4), F.slice(v, 9, 4), lambda a, b: a + 0.5 * b)
    best = F.zip_with(weak, strong, lambda a, b: 0.6 * a + b)
    kind = F.col("label") % 3
    number = F.col("vec_id")
    rows = vectors(spark, sf_dir).select(
        "vec_id", T.sha_hex(F.concat(F.lit("emb|"), number.cast("string")), 24).alias("query_id"), F.concat(F.lit("src"), kind.cast("string")).alias("source"), role_of(number).alias("role"),
        F.when(kind == 0, "science_mc").when(kind == 1, "knowledge_mc").otherwise("multi_hop_qa").alias("task_type"), F.when(kind == 2, "em").otherwise("accuracy").alias("metric"),
        F.element_at(F.array(*[F.lit(x) for x in LETTERS]), F.array_position(best, F.array_max(best)).cast("int")).alias("gold"), S.softmax_map(weak, LETTERS, 8.0).alias("weak_probs"), S.softmax_map(strong, LETTERS, 8.0).alias("strong_probs"),
        F.get(v, F.lit(12)).alias("C_length"), F.when(number % 31 != 0, F.get(v, F.lit(13))).alias("C_density"), F.get(v, F.lit(14)).alias("C_atypical"), F.get(v, F.lit(15)).alias("C_linguistic"),
        F.when(number % 97 != 6, 100.0 + number % 17).alias("weak_latency"), F.when(number % 89 != 8, 900.0 + number % 101).alias("strong_latency"), (~((number % 50 == 4))).alias("strong_there"),
    )
    rows = rows.withColumn("C_query", (F.col("C_length") + F.coalesce("C_density", F.lit(0.0)) + F.col("C_atypical") + F.col("C_linguistic")) / 4.0)
    return rows.withColumn("is_mc", F.col("task_type").endswith("_mc") | (F.col("metric") != "em"))


def probes(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Probe records of the weak or the strong model."""
    rows = probe_base(spark, sf_dir)
    if which == "strong":
        rows = rows.where("strong_there")
    s = S.distribution_scores(F.col(f"{which}_probs"))
    return rows.withColumn("s", s).select("query_id", F.lit(which).alias("model_role"), "source", "role", F.col(f"{which}_probs").alias("probs"), "s.*", F.col(f"{which}_latency").alias("latency_ms"))


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined relation: columns of one table, so that reading it again costs a scan and narrow joins."""
    base = probe_base(spark, sf_dir)
    corpus_rows = base.select("query_id", "vec_id", "source", "role", "task_type", "metric", "gold", "is_mc")
    phi = base.select("query_id", "C_length", "C_density", "C_atypical", "C_linguistic", "C_query")
    return routing.joined_rows(corpus_rows, phi, probes(spark, sf_dir, "weak"), probes(spark, sf_dir, "strong"))
