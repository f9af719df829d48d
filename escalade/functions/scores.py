"""Reductions of answer distributions, and the deterministic stand-in model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


def distribution_scores(probs: Column) -> Column:
    """struct of H, p_max, pred, margin, top2_mass, perplexity_H, inv_p_max, surprisal, n_options from map<letter, probability>.

    Probabilities are renormalised, uniform where their sum is not positive; of equal ones the largest letter wins.
    """
    total = F.aggregate(F.map_values(probs), F.lit(0.0), lambda a, x: a + x)
    n = F.size(probs)
    shares = F.transform(F.map_entries(probs), lambda e: F.struct(F.when(total > 0, e["value"] / F.when(total > 0, total).otherwise(F.lit(1.0))).otherwise(F.lit(1.0) / n).alias("p"), e["key"].alias("letter")))
    return summary(F.sort_array(shares, asc=False))


def summary(ranked: Column) -> Column:
    """Scores of array<struct<p, letter>>, best first."""
    h = F.aggregate(ranked, F.lit(0.0), lambda a, e: a - F.when(e["p"] > 0, e["p"] * F.log(F.when(e["p"] > 0, e["p"]).otherwise(F.lit(1.0)))).otherwise(F.lit(0.0)))
    first = F.get(ranked, F.lit(0))
    second = F.coalesce(F.get(ranked, F.lit(1))["p"], F.lit(0.0))
    p = first["p"]
    infinite = F.lit(float("inf"))
    return F.struct(
        h.alias("H"), p.alias("p_max"), first["letter"].alias("pred"), (p - second).alias("margin"), (p + second).alias("top2_mass"), F.exp(h).alias("perplexity_H"),
        F.when(p > 0, F.lit(1.0) / F.when(p > 0, p).otherwise(F.lit(1.0))).otherwise(infinite).alias("inv_p_max"), F.when(p > 0, -F.log(F.when(p > 0, p).otherwise(F.lit(1.0)))).otherwise(infinite).alias("surprisal"), F.size(ranked).alias("n_options"),
    )


def softmax_map(logits: Column, letters: list[str], scale: float) -> Column:
    e = F.transform(logits, lambda x: F.exp(x * scale))
    z = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.map_from_arrays(F.array(*[F.lit(x) for x in letters]), F.transform(e, lambda x: x / z))


def stand_in_seed(qid: Column, model_id: Column, salt: str) -> Column:
    """First 32 bits of a hash of id, model and salt."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", qid, model_id, F.lit(salt)), 256), 1, 8), 16, 10).cast("long")


def stand_in_letters(qid: Column, model_id: Column, letters: list[str]) -> Column:
    """Letter probabilities of the stand-in model."""
    seed = stand_in_seed(qid, model_id, "mc")
    logits = [((F.shiftright(seed, 5 * i) % 97) + 1 + (seed % 11 if i == 0 else 0)).cast("double") for i in range(len(letters))]
    return softmax_map(F.array(*logits), letters, 0.1)


def stand_in_samples(qid: Column, model_id: Column, n: int, seed: int) -> Column:
    """n sampled answers of the stand-in model."""
    base = stand_in_seed(qid, model_id, f"hotpot|{seed}")
    pool = F.array(*[F.lit(a) for a in L.SAMPLE_POOL])
    return F.array(*[F.element_at(pool, ((base + 3 * i) % len(L.SAMPLE_POOL) + 1).cast("int")) for i in range(n)])


def finite(c: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def json_safe(c: Column) -> Column:
    return F.when(finite(c), c)


def gap_recovered(r: Column, weak: Column, strong: Column) -> Column:
    """Share of the gap between the weak and the strong model that r closes; NaN without a gap."""
    gap = strong - weak
    return F.when(F.abs(gap) < 1e-12, F.lit(float("nan"))).otherwise((r - weak) / F.when(F.abs(gap) < 1e-12, F.lit(1.0)).otherwise(gap))
