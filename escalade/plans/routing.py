"""Joined rows, feature ranking, scores, threshold sweep, choice of thresholds, frozen evaluation, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.scores import finite, gap_recovered
from ..operators.corpus import last_of, random_key
from ..operators.ranking import accuracy, auroc, sliced

FEATURES = [*L.PHI, *L.PSI]


def frozen(artifact: DataFrame) -> DataFrame:
    """A fitted artifact (at most a few hundred rows by its nature: features, sets, thresholds) computed now and kept as literals, as files of the command line would."""
    return artifact.sparkSession.createDataFrame([tuple(r) for r in artifact.collect()], artifact.schema)


def joined_rows(corpus: DataFrame, phi: DataFrame, weak: DataFrame, strong: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Corpus with features and weak probes (inner) and strong probes (left), correctness and routing labels. Of rows of one id in a table that has the column `ordinal`, the last one counts."""
    phi, weak, strong = (last_of(t, ["query_id"], F.col(ordinal)).drop(ordinal) if ordinal in t.columns else t for t in (phi, weak, strong))
    w = weak.select("query_id", F.col("pred").alias("weak_pred"), *L.PSI, F.col("latency_ms").alias("latency_weak"))
    s = strong.select("query_id", F.col("pred").alias("strong_pred"), F.col("latency_ms").alias("latency_strong"), F.lit(True).alias("__s"))
    rows = corpus.join(phi, "query_id").join(w, "query_id").join(s, "query_id", "left")
    ok = lambda c: T.is_correct(F.col(c), F.col("gold"), F.col("metric"))
    rows = rows.withColumns({"has_strong": F.coalesce("__s", F.lit(False)), "weak_ok": ok("weak_pred")}).withColumn("strong_ok", F.when(F.col("has_strong"), ok("strong_pred")))
    strong_ok = F.coalesce("strong_ok", F.lit(False))
    return rows.withColumns({"weak_wrong": ~F.col("weak_ok"), "needs_strong": ~F.col("weak_ok") & strong_ok, "both_wrong": ~F.col("weak_ok") & F.col("has_strong") & ~strong_ok, "z_vec": F.array(*[F.col(f).cast("double") for f in FEATURES])}).drop("__s")


def unpivoted(rows: DataFrame, keep: list[str], features: list[str] | None = None) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features or FEATURES])
    return rows.select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.*")


def direction_of(feature: Column, directions: dict[str, int] | None = None) -> Column:
    pairs = [F.lit(x) for kv in (directions or L.DIRECTIONS).items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), feature), F.lit(1))


def accuracy_by_slice(rows: DataFrame) -> DataFrame:
    return sliced(rows).groupBy("slice").agg(F.count("*").alias("n"), accuracy(F.col("weak_ok")).alias("accuracy"))


def ranked_features(rows: DataFrame, directions: dict[str, int] | None = None) -> DataFrame:
    """(slice, feature, direction, auroc, auroc_flipped, best_auroc, n, n_pos) over rows with a strong answer; slices of one class are left out."""
    labelled = unpivoted(sliced(rows.where("has_strong")), ["slice", "needs_strong"])
    d = direction_of(F.col("feature"), directions)
    got = auroc(labelled, ["slice", "feature"], F.col("needs_strong"), F.col("value") * d).where("n_pos > 0 and n_pos < n")
    return got.select("slice", "feature", direction_of(F.col("feature"), directions).alias("direction"), "auroc", (1.0 - F.col("auroc")).alias("auroc_flipped"), F.greatest(F.col("auroc"), 1.0 - F.col("auroc")).alias("best_auroc"), "n", "n_pos")


def pooled_order(ranks: DataFrame) -> DataFrame:
    """(feature, place) by pooled AUROC descending, then name: at most one row a feature."""
    value = F.when(F.isnan("auroc"), -1.0).otherwise(F.coalesce("auroc", F.lit(-1.0)))
    return ranks.where("slice = 'pooled'").select("feature", F.row_number().over(Window.orderBy(value.desc(), "feature")).alias("place"))


def feature_sets(order: DataFrame) -> DataFrame:
    """(set, feature): the named sets and the best 2, 4 and 5 features."""
    spark = order.sparkSession
    named = spark.createDataFrame([(k, f) for k, fs in L.NAMED_SETS.items() for f in fs], "set string, feature string")
    tops = spark.createDataFrame(list(L.TOP_SETS.items()), "set string, size int")
    return named.unionByName(order.join(F.broadcast(tops), F.col("place") <= F.col("size")).select("set", "feature"))


def feature_stats(rows: DataFrame) -> DataFrame:
    """(feature, mean, std) over finite values; (0, 1) without any, std of at most 1e-9 counts as 1."""
    kept = unpivoted(rows, []).withColumn("value", F.when(finite(F.col("value")), F.col("value")))
    stats = kept.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return stats.select("feature", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.when(F.col("std") > 1e-9, F.col("std")).otherwise(F.lit(1.0)).alias("std"))


def set_scores(rows: DataFrame, stats: DataFrame, sets: DataFrame, keep: list[str], directions: dict[str, int] | None = None) -> DataFrame:
    """(set, keep, score): mean of the oriented z of a set's finite features; null without any. Scores have 9 decimals, so that equal ones are equal in every engine."""
    # Statistics and sets are one row a feature: small by their nature.
    long = unpivoted(rows, keep).join(F.broadcast(stats), "feature").join(F.broadcast(sets), "feature")
    z = direction_of(F.col("feature"), directions) * (F.col("value") - F.col("mean")) / F.col("std")
    return long.groupBy("set", *keep).agg(F.round(F.avg(F.when(finite(F.col("value")), z)), 9).alias("score"))


def escalated(score: Column, tau: Column) -> Column:
    """True where the score reaches the threshold; unknown scores do not."""
    return F.coalesce(~F.isnan(score) & (score >= tau), F.lit(False))


def _routed(esc: Column) -> Column:
    """Accuracy of the routed answers; NaN where an escalated row has no strong one."""
    value = F.avg(F.when(esc, F.col("strong_ok")).otherwise(F.col("weak_ok")).cast("double"))
    return F.when(F.max((esc & ~F.col("has_strong")).cast("int")) == 1, F.lit(float("nan"))).otherwise(value)


def swept(scores: DataFrame) -> DataFrame:
    """One job for all sets and thresholds: (set, idx, tau, tau_tag, alpha, accuracy, pgr, r_weak, r_strong).

    Thresholds are +inf, the distinct values of 51 quantiles in ascending order, -inf.
    """
    grid = [k / L.QUANTILE_STEPS for k in range(L.QUANTILE_STEPS + 1)]
    known = scores.where(F.col("score").isNotNull() & ~F.isnan("score"))
    quantiles = known.groupBy("set").agg(F.transform(F.percentile("score", grid), lambda x: F.round(x, 9)).alias("q"))
    distinct = F.array_distinct("q")
    taus = quantiles.select("set", F.posexplode(F.concat(F.array(F.lit(float("inf"))), distinct, F.array(F.lit(float("-inf"))))).alias("idx", "tau"))
    weak, strong = F.col("weak_ok").cast("long"), F.coalesce(F.col("strong_ok").cast("long"), F.lit(0))
    totals = scores.groupBy("set").agg(F.count("*").alias("n"), F.sum(weak).alias("weak"), F.sum(strong).alias("strong"), F.count_if("has_strong").alias("n_strong"))
    # A score's cell is the number of thresholds it reaches, so rows are summed once whatever the number of thresholds.
    cell = F.size(F.filter("grid", lambda t: t <= F.col("score")))
    cells = known.join(F.broadcast(quantiles.select("set", distinct.alias("grid"))), "set").groupBy("set", cell.alias("cell")).agg(F.count("*").alias("c"), F.sum(weak).alias("w"), F.sum(strong).alias("s"), F.count_if(~F.col("has_strong")).alias("missing"))
    above = taus.where("abs(tau) <> double('inf')").join(F.broadcast(cells), "set").where("cell >= idx").groupBy("set", "idx", "tau").agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.sum("s").alias("s"), F.sum("missing").alias("missing"))
    # -inf escalates every row, those without a score too; +inf none.
    full = taus.join(above, ["set", "idx", "tau"], "left").join(totals, "set")
    everything = F.col("tau") == float("-inf")
    c = F.when(everything, F.col("n")).otherwise(F.coalesce("c", F.lit(0)))
    w = F.when(everything, F.col("weak")).otherwise(F.coalesce("w", F.lit(0)))
    s = F.when(everything, F.col("strong")).otherwise(F.coalesce("s", F.lit(0)))
    missing = F.when(everything, F.col("n") - F.col("n_strong")).otherwise(F.coalesce("missing", F.lit(0)))
    r = F.when(missing > 0, F.lit(float("nan"))).otherwise((F.col("weak") - w + s) / F.col("n"))
    r_weak, r_strong = F.col("weak") / F.col("n"), F.when(F.col("n_strong") > 0, F.col("strong") / F.greatest("n_strong", F.lit(1))).otherwise(F.lit(float("nan")))
    tag = F.when(F.col("tau") == float("inf"), "always_weak").when(everything, "always_strong").otherwise("threshold")
    out = full.select("set", "idx", F.when(F.abs("tau") != float("inf"), F.col("tau")).alias("tau"), tag.alias("tau_tag"), (c / F.col("n")).alias("alpha"), r.alias("accuracy"), r_weak.alias("r_weak"), r_strong.alias("r_strong"))
    return out.withColumn("pgr", gap_recovered(F.col("accuracy"), F.col("r_weak"), F.col("r_strong")))


def call_rates(curve: DataFrame) -> DataFrame:
    """(set, cpt50, cpt80): least share of strong calls that recovers half, or 80 %, of the gap; NaN if none does."""
    at = lambda t: F.coalesce(F.min(F.when(finite(F.col("pgr")) & (F.col("pgr") >= t), F.col("alpha"))), F.lit(float("nan")))
    return curve.groupBy("set").agg(at(0.5).alias("cpt50"), at(0.8).alias("cpt80"))


def picked(curve: DataFrame, select: str = "cpt80", alpha_max: float = 0.25) -> DataFrame:
    """(set, tau, alpha, accuracy, pgr, fallback, cpt50, cpt80): each set's operating point.

    cpt50 and cpt80 take the least share of strong calls that reaches the target, max_pgr_at_alpha the best gap within
    alpha_max; ties go to the smaller threshold. What cannot be reached falls back to the largest gap recovered.
    """
    usable = F.when(finite(F.col("pgr")), F.col("pgr")).otherwise(F.lit(-1e9))
    if select in ("cpt50", "cpt80"):
        fits = finite(F.col("pgr")) & (F.col("pgr") >= (0.5 if select == "cpt50" else 0.8))
        order = [F.when(fits, 0).otherwise(1), F.when(fits, F.round("alpha", 12)), F.round(usable, 12).desc(), "idx"]
    elif select == "max_pgr_at_alpha":
        fits = F.col("alpha") <= alpha_max + 1e-12
        order = [F.when(fits, 0).otherwise(1), F.round(usable, 12).desc(), "idx"]
    else:
        raise ValueError(f"unknown rule {select!r}")
    threshold = F.max((F.col("tau_tag") == "threshold").cast("int")).over(Window.partitionBy("set")) == 1
    pool = curve.withColumn("__any", threshold).where((F.col("tau_tag") == "threshold") | ~F.col("__any"))
    best = pool.withColumn("fallback", ~fits).withColumn("__rn", F.row_number().over(Window.partitionBy("set").orderBy(*order))).where("__rn = 1")
    return best.select("set", "tau", "alpha", "accuracy", "pgr", "fallback").join(call_rates(curve), "set")


def evaluated(scores: DataFrame, taus: DataFrame) -> DataFrame:
    """(set, slice, n, alpha, accuracy, pgr, mean_path_latency_ms) at frozen thresholds; a null threshold gives null figures. scores has source and is_mc."""
    marked = sliced(scores.join(F.broadcast(taus.select("set", "tau")), "set"))
    esc = escalated(F.col("score"), F.col("tau"))
    latency = F.when(F.col("latency_weak").isNotNull(), F.col("latency_weak") + F.when(esc, F.coalesce("latency_strong", F.lit(0.0))).otherwise(F.lit(0.0)))
    per = marked.groupBy("set", "slice", "tau").agg(F.count("*").alias("n"), F.avg(esc.cast("double")).alias("alpha"), _routed(esc).alias("accuracy"), accuracy(F.col("weak_ok")).alias("rw"), accuracy(F.when(F.col("has_strong"), F.col("strong_ok"))).alias("rs"), F.avg(latency).alias("mean_path_latency_ms"))
    per = per.withColumn("pgr", gap_recovered(F.col("accuracy"), F.col("rw"), F.col("rs")))
    known = lambda c: F.when(F.col("tau").isNotNull(), F.col(c)).alias(c)
    return per.select("set", "slice", "n", known("alpha"), known("accuracy"), known("pgr"), known("mean_path_latency_ms"))


def markers(curve: DataFrame, taus: DataFrame) -> DataFrame:
    """(set, tau, calib_alpha, alpha, accuracy, pgr): the curve's point at each chosen threshold, the nearest grid point from below."""
    near = curve.where("tau_tag = 'threshold'").alias("c").join(F.broadcast(taus.select("set", F.col("tau").alias("star"), F.col("alpha").alias("calib_alpha"))), "set")
    rn = F.row_number().over(Window.partitionBy("set").orderBy(F.abs(F.col("tau") - F.col("star")), "idx"))
    return near.withColumn("__rn", rn).where("__rn = 1").select("set", F.col("star").alias("tau_star"), "calib_alpha", "alpha", "accuracy", "pgr")


def curve_points(curve: DataFrame) -> DataFrame:
    """What the curve figures show: threshold points by share of strong calls."""
    return curve.where("tau_tag = 'threshold'").select("set", "idx", "alpha", "accuracy", "pgr")


def incomplete(rows: DataFrame) -> DataFrame:
    """(source, n): rows without a strong probe; none is empty."""
    return rows.where(~F.col("has_strong")).groupBy("source").agg(F.count("*").alias("n"))


def assert_complete(rows: DataFrame) -> None:
    if not incomplete(rows).isEmpty():
        raise ValueError("rows without a strong probe")


def two_signal_rule(c: Column, h: Column, u: Column, tau_c: float, tau_h: float, tau_u: float) -> dict[str, Column]:
    """The simple rules: complexity alone, entropy or disagreement."""
    return {"c_only": escalated(c, F.lit(tau_c)), "h_or_u": escalated(h, F.lit(tau_h)) | escalated(u, F.lit(tau_u))}


def weighted_rule(z: dict[str, float], tau: float) -> Column:
    total: Column = F.lit(0.0)
    for feature, weight in z.items():
        total = total + F.col(feature) * weight
    return escalated(total, F.lit(tau))


def random_escalation(alpha: float, seed: int, key: str) -> Column:
    """Escalates a share alpha of the rows by a hash of the key."""
    return F.conv(F.substring(random_key(seed, F.col(key)), 1, 8), 16, 10).cast("double") < alpha * 2.0**32
