"""Probing models: surfaces, answers, reductions, cost."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T

# Short names of models and the repositories they stand for.
MODEL_IDS = {
    "llama-3.1-8b-instruct": "meta-llama/Llama-3.1-8B-Instruct",
    "llama-3.1-70b-instruct": "meta-llama/Llama-3.1-70B-Instruct",
    "qwen2.5-7b-instruct": "Qwen/Qwen2.5-7B-Instruct",
    "qwen2.5-32b-instruct": "Qwen/Qwen2.5-32B-Instruct",
    "gemma-2-27b-it": "google/gemma-2-27b-it",
}


class Backend(Protocol):
    """A model on the workers: letter probabilities and sampled answers for batches of prompts."""

    def letters(self, prompts: list[str], choices: list[list[str]], ids: list[str]) -> list[dict[str, float]]: ...

    def samples(self, prompts: list[str], n: int, ids: list[str]) -> list[list[str]]: ...


def with_backend(rows: DataFrame, make: Callable[[], Backend], n_samples: int) -> DataFrame:
    """rows(query_id, prompt, labels) with probs and samples; one backend a worker process, whole Arrow batches to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for b in batches:
            ids, prompts, labels = list(b["query_id"]), list(b["prompt"]), [list(x) for x in b["labels"]]
            yield pd.DataFrame({"query_id": ids, "probs": [list(p.items()) if x else None for x, p in zip(labels, backend.letters(prompts, labels, ids), strict=True)], "samples": backend.samples(prompts, n_samples, ids)})

    return rows.select("query_id", "prompt", "labels").mapInPandas(run, "query_id string, probs array<struct<letter:string,p:double>>, samples array<string>").withColumn("probs", F.map_from_entries("probs"))


#: Fixed value: tokens of an answer of the stand-in model.
ANSWER_TOKENS = 8


def model_pool(pool: dict[str, dict[str, str]], experiment: str, roles: list[str] | None = None) -> list[tuple[str, str]]:
    """(role, model id) of an experiment, weak before strong."""
    if experiment not in pool:
        raise ValueError(f"unknown experiment {experiment!r}")
    return [(r, MODEL_IDS.get(pool[experiment][r], pool[experiment][r])) for r in ("weak", "strong") if r in pool[experiment] and (not roles or r in roles)]


def is_mc_probe(task_type: Column, prompt: Column) -> Column:
    return task_type.endswith("_mc") | F.regexp_like(prompt, F.lit(r"(?dm)^[A-E]\.\s+"))


def is_mc_analysis(task_type: Column, metric: Column) -> Column:
    return task_type.endswith("_mc") | (metric != "em")


def surface_prompts(rows: DataFrame, k: int) -> DataFrame:
    """rows(query_id, prompt) once per surface: surface_no, surface_prompt."""
    p = F.col("prompt")
    parts = rows.withColumns({"__labels": T.option_labels(p), "__texts": T.option_texts(p), "__question": T.question(p), "__context": T.context_prefix(p)})
    formed = parts.withColumn("__forms", T.paraphrase_surfaces(F.col("__question"), k, F.col("query_id")))
    built = F.transform("__forms", lambda s: F.when(F.size("__labels") > 0, T.labelled_prompt(s, F.col("__labels"), F.col("__texts"))).otherwise(T.free_prompt(F.col("__context"), s)))
    return formed.withColumn("__built", built).select(*rows.columns, F.posexplode("__built").alias("surface_no", "surface_prompt"))


def answer_clusters(answers: DataFrame, key: list[str], answer: str = "answer", position: str = "pos") -> DataFrame:
    """Scores of sampled answers grouped by their normal form: the first raw answer of the mode stands for it, ties go to the first seen."""
    forms = answers.withColumn("form", T.normalized_answer(F.col(answer))).groupBy(*key, "form").agg(F.count("*").alias("n"), F.min(F.struct(F.col(position).alias("pos"), F.col(answer).alias("raw"))).alias("first"))
    entries = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), F.col("first.pos").alias("pos"), F.col("first.raw").alias("raw"))))
    grouped = forms.groupBy(*key).agg(F.sum("n").alias("n_samples"), entries.alias("e"))
    ranked = F.transform("e", lambda x: F.struct((-x["minus"] / F.col("n_samples")).alias("p"), x["raw"].alias("letter")))
    return grouped.withColumn("s", S.summary(ranked)).select(*key, "n_samples", F.size("e").alias("n_clusters"), *[F.col(f"s.{c}").alias(c) for c in ("H", "p_max", "pred", "margin", "top2_mass")])


def paraphrase_agreement(preds: DataFrame, key: list[str], pred: str = "pred", position: str = "pos") -> DataFrame:
    """U = 1 - share of the most frequent prediction, agreement, k and mode; ties go to the first seen."""
    counts = preds.groupBy(*key, pred).agg(F.count("*").alias("n"), F.min(position).alias("pos"))
    best = counts.groupBy(*key).agg(F.sum("n").alias("k"), F.min(F.struct((-F.col("n")).alias("minus"), "pos", F.col(pred).alias("mode"))).alias("b"))
    share = -F.col("b.minus") / F.col("k")
    return best.select(*key, (1.0 - share).alias("U"), share.alias("agreement"), "k", F.col("b.mode").alias("mode"))


def cost_trace(events: DataFrame, key: list[str]) -> DataFrame:
    """Sums of a key's calls (latency_ms, prompt_tokens, completion_tokens, n_calls, kind, pos)."""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    return events.groupBy(*key).agg(
        F.round(F.sum(F.coalesce("latency_ms", F.lit(0.0))), 3).alias("latency_ms"), total("prompt_tokens").alias("prompt_tokens"), total("completion_tokens").alias("completion_tokens"), (total("prompt_tokens") + total("completion_tokens")).alias("total_tokens"),
        F.sum(F.coalesce("n_calls", F.lit(1))).alias("n_calls"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "kind"))), lambda x: x["kind"]).alias("kinds"),
    )


def usd(costs: DataFrame, prices: DataFrame) -> DataFrame:
    """costs(model_id, model_role, prompt_tokens, completion_tokens) with usd_est by the model's price, else its role's."""
    by = lambda c: prices.select(F.col("name").alias(c), F.struct("usd_in", "usd_out").alias(f"price_{c}"))
    both = costs.join(by("model_id"), "model_id", "left").join(by("model_role"), "model_role", "left")
    price = F.coalesce("price_model_id", "price_model_role")
    return both.withColumn("usd_est", F.round((F.col("prompt_tokens") * price["usd_in"] + F.col("completion_tokens") * price["usd_out"]) / 1e6, 8)).drop("price_model_id", "price_model_role")


def stand_in_records(corpus: DataFrame, model_id: str, model_role: str, k: int = 3, n_samples: int = 3, prices: DataFrame | None = None, paraphraser: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Probe records of the deterministic stand-in model, one a query: answer scores on the first surface, agreement over k surfaces, cost of all its calls.

    k of at most 1 probes the prompt alone; U, agreement and mode are null then. Tokens are white-space separated
    words; prices(name, usd_in, usd_out) adds usd_est. paraphraser(rows, k) takes the place of surface_prompts.
    """
    letters = F.array(*[F.lit(x) for x in "ABCDE"])
    rows = corpus.withColumns({"labels": T.option_labels(F.col("prompt")), "model": F.lit(model_id)}).withColumns({"is_mc": F.size("labels") > 0, "all_probs": S.stand_in_letters(F.col("query_id"), F.lit(model_id), list("ABCDE"))})
    rows = rows.withColumn("probs", F.map_filter("all_probs", lambda a, _: F.array_contains(F.slice(letters, 1, F.size("labels")), a))).drop("all_probs")
    rows = rows.withColumns({"answer_scores": F.when(F.col("is_mc"), S.distribution_scores(F.col("probs"))), "samples": S.stand_in_samples(F.col("query_id"), F.lit(model_id), max(n_samples, 1), 0)})
    mc, free = rows.where("is_mc"), rows.where("not is_mc")
    clustered = answer_clusters(free.select("query_id", F.posexplode("samples").alias("pos", "answer")), ["query_id"])
    own = ["query_id", F.lit(model_id).alias("model_id"), F.lit(model_role).alias("model_role"), "source", "role"]
    a = mc.select(*own, F.lit("mc_letter").alias("probe"), *[F.col(f"answer_scores.{c}").alias(c) for c in ("H", "p_max", "pred", "margin", "top2_mass")])
    b = free.join(clustered, "query_id").select(*own, F.lit("freeform_clusters").alias("probe"), "H", "p_max", "pred", "margin", "top2_mass")
    several = k > 1
    surfaces = (paraphraser or surface_prompts)(rows, k) if several else rows.withColumns({"surface_no": F.lit(0), "surface_prompt": F.col("prompt")})
    # The stand-in answers every surface as it answers the first one.
    answer = F.when(F.col("is_mc"), F.col("answer_scores.pred")).otherwise(F.col("samples")[0])
    asked = surfaces.select("query_id", "surface_no", F.greatest(F.size(T.spaced(F.col("surface_prompt"))), F.lit(1)).cast("long").alias("prompt_tokens"), "is_mc", answer.alias("answer"))
    call = lambda rows, pos, n: rows.select("query_id", F.lit(None).cast("double").alias("latency_ms"), "prompt_tokens", F.when(F.col("is_mc"), 0).otherwise(ANSWER_TOKENS * n).cast("long").alias("completion_tokens"), F.lit(1).alias("n_calls"), F.when(F.col("is_mc"), "mc_letter").otherwise("freeform_sample").alias("kind"), pos.alias("pos"))
    calls = call(asked.where("surface_no = 0"), F.lit(0), n_samples).unionByName(call(asked, F.col("surface_no") + 1, 1))
    cost = cost_trace(calls, ["query_id"]).drop("kinds")
    agreement = paraphrase_agreement(asked, ["query_id"], "answer", "surface_no")
    if not several:
        agreement = agreement.select("query_id", *[F.lit(None).cast(agreement.schema[c].dataType).alias(c) for c in ("U", "agreement")], "k", F.lit(None).cast("string").alias("mode"))
    out = a.unionByName(b).join(agreement, "query_id").join(cost, "query_id")
    return out if prices is None else usd(out, prices)
