"""The registered queries. Doubles are rounded to six places; NaN and infinities become null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import scores as S
from ..functions import text as T
from ..operators import corpus as C
from ..operators import features as X
from ..operators import geometry as G
from ..operators import probe as P
from ..operators import quality as V
from ..operators.ranking import auroc, average_rank, sliced, tiled, with_rows_before
from ..sources import store
from . import relations as D
from . import routing as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(S.json_safe(F.col(c)), 6) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# Corpus


@query
def auroc_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.table(spark, sf, "documents").join(D.table(spark, sf, "labels"), "doc_id")
    return rounded(auroc(rows, [], F.col("quality") == 0, F.round(F.col("n_chars") / 100)))


@query
def corpus_rows(spark: SparkSession, sf: str) -> DataFrame:
    return D.corpus(spark, sf).select("query_id", "source", "config", "role", "gold", "text_hash", F.length("prompt").cast("long").alias("n"))


@query
def counts_by_source_role(spark: SparkSession, sf: str) -> DataFrame:
    return D.corpus(spark, sf).groupBy("source", "role").agg(F.count("*").alias("n"))


@query
def split_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return C.fingerprints(D.corpus(spark, sf))


@query
def text_leakage(spark: SparkSession, sf: str) -> DataFrame:
    return C.text_leakage(D.corpus(spark, sf))


@query
def corpus_check_violations(spark: SparkSession, sf: str) -> DataFrame:
    return C.violations(D.corpus(spark, sf))


@query
def contam_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    docs = D.table(spark, sf, "documents").select("doc_id", T.text_hash(F.col("text")).alias("h"))
    return docs.join(D.table(spark, sf, "benchmark").select("item_id", T.text_hash(F.col("text")).alias("h")), "h").select("doc_id", "item_id")


def _mc(spark: SparkSession, sf: str) -> DataFrame:
    regions = D.table(spark, sf, "region").agg(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))).alias("r"))
    rows = D.table(spark, sf, "nation").crossJoin(F.broadcast(regions))
    return rows.select("n_nationkey", F.concat(F.lit("Which region holds "), F.col("n_name"), F.lit("?")).alias("stem"), F.transform("r", lambda x: x["r_name"]).alias("texts"), F.transform("r", lambda x: x["r_regionkey"].cast("string")).alias("labels"), F.col("n_regionkey").cast("string").alias("key"))


@query
def mc_prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    return _mc(spark, sf).select("n_nationkey", T.mc_prompt(F.col("stem"), F.col("texts")).alias("prompt"))


@query
def mc_prompt_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = mc_prompt_build(spark, sf)
    p = F.col("prompt")
    return rows.select("n_nationkey", T.question(p).alias("question"), F.array_join(T.option_labels(p), ",").alias("labels"), F.array_join(T.option_texts(p), ",").alias("texts"), (T.labelled_prompt(T.question(p), T.option_labels(p), T.option_texts(p)) == p).alias("same"))


@query
def arc_choice_norm(spark: SparkSession, sf: str) -> DataFrame:
    fixed = C.relabelled_choices(F.col("labels"), F.col("texts"), F.when(F.col("n_nationkey") % 7 == 0, "B").when(F.col("n_nationkey") % 7 == 1, "Z").otherwise(F.col("key")))
    return _mc(spark, sf).select("n_nationkey", fixed["gold"].alias("gold"), F.size(fixed["texts"]).cast("long").alias("n_choices"))


@query
def hotpot_prompt_policies(spark: SparkSession, sf: str) -> DataFrame:
    nations = D.table(spark, sf, "nation").select("n_regionkey", F.struct("n_nationkey", "n_name").alias("n"))
    rows = D.table(spark, sf, "region").join(nations.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list("n")).alias("ns")), "r_regionkey")
    titles = F.transform("ns", lambda n: n["n_name"])
    sentences = F.transform("ns", lambda n: F.array(F.concat(n["n_name"], F.lit(" is a nation.")), F.concat(F.lit("Its key is "), n["n_nationkey"].cast("string"), F.lit("."))))
    supporting = F.slice(titles, 1, 2)
    out = [C.context_prompt(C.paragraphs(titles, sentences, supporting, p), F.concat(F.lit("What lies in "), F.col("r_name"), F.lit("?"))).alias(p) for p in ("full_context", "gold_only", "question_only")]
    return rows.select("r_regionkey", *out)


@query
def hotpot_prompt_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = hotpot_prompt_policies(spark, sf)
    long = rows.select("r_regionkey", F.explode(F.array("full_context", "gold_only", "question_only")).alias("p"))
    return long.select("r_regionkey", F.length("p").cast("long").alias("n"), T.free_question(F.col("p")).alias("question"), T.context_prefix(F.col("p")).alias("prefix"), (T.free_prompt(T.context_prefix(F.col("p")), T.free_question(F.col("p"))) == F.col("p")).alias("same"))


@query
def mmlu_gold(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.when(F.col("p_partkey") % 2 == 0, (F.col("p_partkey") % 4).cast("string")).otherwise(F.substring("p_brand", 1, 1))
    return D.table(spark, sf, "part").select("p_partkey", C.letter_gold(answer).alias("gold"))


@query
def mmlu_dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.table(spark, sf, "part").select("p_partkey", T.query_id(F.col("p_brand"), F.col("p_type"), F.lit("test"), F.col("p_size")).alias("query_id"))
    return C.first_of(rows, ["query_id"], F.col("p_partkey"))


@query
def sample_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return C.stratified_sample(D.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), 100, 13, "c_custkey", "c_mktsegment").select("c_custkey", "c_mktsegment", F.col("turn").cast("long").alias("turn"))


@query
def sample_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    return C.disjoint_splits(D.table(spark, sf, "customer").select("c_custkey"), {"calib": 40, "fit": 80}, 5, "c_custkey")


@query
def head_limit(spark: SparkSession, sf: str) -> DataFrame:
    return C.head_per_role(D.corpus(spark, sf).select("query_id", "role", "doc_id"), 8, "doc_id")


# Text features


def _phi(spark: SparkSession, sf: str, compression: bool = False) -> DataFrame:
    return X.prompt_features(D.corpus(spark, sf).select("doc_id", "role", "prompt"), compression=compression)


@query
def feat_structural(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_phi(spark, sf).select("doc_id", *[F.col(f"structural.{f}").alias(f) for f in X.STRUCTURAL if f != "compression_ratio"]))


@query
def feat_linguistic(spark: SparkSession, sf: str) -> DataFrame:
    return _phi(spark, sf).select("doc_id", *[F.col(f"linguistic_cues.{f}").alias(f) for f in X.LINGUISTIC])


@query
def feat_compression(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.corpus(spark, sf).select("doc_id", T.compression_ratio(F.col("prompt")).alias("compression_ratio")))


@query
def feat_conversations(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    return rounded(X.prompt_features(rows, compression=False).select("conv_id", "turn", *[F.col(f"linguistic_cues.{f}").alias(f) for f in ("n_requirements", "domain_breadth", "n_question_marks", "n_sentences")], F.col("structural.prompt_token_len").alias("prompt_token_len")))


@query
def task_form(spark: SparkSession, sf: str) -> DataFrame:
    rows = mc_prompt_build(spark, sf).withColumn("task_type", F.when(F.col("n_nationkey") % 3 == 0, "multi_hop_qa").otherwise("science_mc"))
    return X.task_form(rows).select("n_nationkey", "task_type", F.col("is_mc").cast("long").alias("is_mc"), F.col("n_choices").cast("long").alias("n_choices"))


BLOCKS = {"structural": tuple(f for f in X.STRUCTURAL if f != "compression_ratio"), "linguistic_cues": X.LINGUISTIC}


@query
def flatten_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.flattened(_phi(spark, sf), "doc_id", BLOCKS))


@query
def zscore_fit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.block_zstats(_phi(spark, sf).where("role = 'fit'"), BLOCKS))


@query
def complexity_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """The composition with geometry: prompt features stand in the vectors' own entries, distances are real."""
    v = D.vectors(spark, sf)
    rows = G.atypicality(v, _fit(v), "vec_id").join(v.select("vec_id", F.struct(F.get("v", F.lit(12)).alias("prompt_token_len"), F.get("v", F.lit(13)).alias("mattr")).alias("structural"), F.struct(F.get("v", F.lit(15)).alias("n_requirements")).alias("linguistic_cues")), "vec_id")
    flat = X.flattened(rows, "vec_id", {"structural": ("prompt_token_len", "mattr"), "linguistic_cues": ("n_requirements",), "embedding_geometry": X.GEOMETRY})
    stats = X.zstats(flat.join(_fit(v).select("vec_id"), "vec_id", "left_semi"))
    return rounded(X.composed(X.zscored(flat, stats, "vec_id"), "vec_id"))


@query
def complexity_scores(spark: SparkSession, sf: str) -> DataFrame:
    flat = X.flattened(_phi(spark, sf), "doc_id", BLOCKS)
    fit = D.corpus(spark, sf).where("role = 'fit'").select("doc_id")
    return rounded(X.composed(X.zscored(flat, X.zstats(flat.join(fit, "doc_id", "left_semi")), "doc_id"), "doc_id"))


@query
def complexity_compressed(spark: SparkSession, sf: str) -> DataFrame:
    """complexity_scores with the compression term; rows only, zlib has no SQL here."""
    flat = X.flattened(_phi(spark, sf, compression=True), "doc_id", {"structural": X.STRUCTURAL, "linguistic_cues": X.LINGUISTIC})
    fit = D.corpus(spark, sf).where("role = 'fit'").select("doc_id")
    return rounded(X.composed(X.zscored(flat, X.zstats(flat.join(fit, "doc_id", "left_semi")), "doc_id"), "doc_id"))


@query
def normalize_answer(spark: SparkSession, sf: str) -> DataFrame:
    return D.table(spark, sf, "conversations").select("conv_id", "turn", T.normalized_answer(F.col("text")).alias("answer"))


@query
def paraphrase_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.table(spark, sf, "conversations").select("conv_id", "turn", F.explode(T.paraphrase_surfaces(F.col("text"), 3, F.concat_ws("-", "conv_id", "turn"))).alias("surface"))
    return rows


@query
def surface_prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = mc_prompt_build(spark, sf).select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("query_id"), "prompt")
    return P.surface_prompts(rows, 3).select("query_id", F.col("surface_no").cast("long").alias("surface_no"), "surface_prompt")


# Geometry


def _fit(v: DataFrame) -> DataFrame:
    return v.where("vec_id % 5 < 3")


@query
def centroid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.centroid(_fit(D.vectors(spark, sf))).select(F.posexplode("centroid").alias("i", "m")).select(F.col("i").cast("long").alias("i"), "m"))


@query
def centroid_distance(spark: SparkSession, sf: str) -> DataFrame:
    v = D.vectors(spark, sf)
    return rounded(G.centroid_distance(v, G.centroid(_fit(v))).select("vec_id", "centroid_distance"))


def _count(df: DataFrame) -> int:
    return df.count()


@query
def knn_similarity(spark: SparkSession, sf: str) -> DataFrame:
    v = D.vectors(spark, sf)
    return rounded(G.knn_similarity(G.neighbours(v, _fit(v), L.KNN, _count(_fit(v)))))


@query
def lof_score(spark: SparkSession, sf: str) -> DataFrame:
    v = D.vectors(spark, sf)
    return rounded(G.outlier_factors(v, _fit(v), _count(_fit(v))))


@query
def pca_project(spark: SparkSession, sf: str) -> DataFrame:
    v = D.vectors(spark, sf)
    return rounded(G.projected(v, G.principal_components(_fit(v)), G.centroid(_fit(v))).select("vec_id", "pc1", "pc2", "pc3"))


@query
def pca_energy(spark: SparkSession, sf: str) -> DataFrame:
    """Squared lengths of the projections on all components: those of the centred vectors."""
    v = D.vectors(spark, sf)
    parts = G.principal_components(_fit(v), 64)
    moved = G.projected(v, parts, G.centroid(_fit(v)))
    names = [f"pc{i + 1}" for i in range(len(parts))]
    return rounded(moved.select("vec_id", F.array(*names).alias("p")).select("vec_id", G.dot(F.col("p"), F.col("p")).alias("energy")))


# Probes


def _scores(spark: SparkSession, sf: str, which: str) -> DataFrame:
    return rounded(D.probes(spark, sf, which).select("query_id", "pred", "H", "p_max", "margin", "top2_mass", "perplexity_H", "inv_p_max", "surprisal", F.col("n_options").cast("long").alias("n_options")))


@query
def mc_scores_weak(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf, "weak")


@query
def mc_scores_strong(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf, "strong")


@query
def stand_in_letters(spark: SparkSession, sf: str) -> DataFrame:
    ids = D.table(spark, sf, "documents").select(F.concat(F.lit("documents|"), F.col("doc_id").cast("string")).alias("q"))
    probs = S.stand_in_letters(F.col("q"), F.lit("weak"), D.LETTERS)
    return rounded(ids.select("q", S.stand_in_seed(F.col("q"), F.lit("weak"), "mc").alias("seed"), *[probs[x].alias(f"p_{x}") for x in D.LETTERS]))


@query
def stand_in_samples(spark: SparkSession, sf: str) -> DataFrame:
    ids = D.table(spark, sf, "documents").select(F.concat(F.lit("documents|"), F.col("doc_id").cast("string")).alias("q"))
    return ids.select("q", F.array_join(S.stand_in_samples(F.col("q"), F.lit("weak"), 3, 0), ",").alias("samples"))


@query
def probe_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = mc_prompt_build(spark, sf).select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("query_id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("prompt")).otherwise("Where is it?").alias("prompt"), F.lit("nation").alias("source"), F.lit("fit").alias("role"))
    return rounded(P.stand_in_records(rows, "weak-8b", "weak"))


@query
def cluster_entropy(spark: SparkSession, sf: str) -> DataFrame:
    events = D.table(spark, sf, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), F.col("event_id").alias("pos"), F.col("event_type").alias("answer"))
    return rounded(P.answer_clusters(events, ["user_id", "day"]).select("user_id", "day", "n_samples", F.col("n_clusters").cast("long").alias("n_clusters"), "H", "p_max", "pred", "margin", "top2_mass"))


@query
def paraphrase_u(spark: SparkSession, sf: str) -> DataFrame:
    events = D.table(spark, sf, "events").select("user_id", F.col("event_id").alias("pos"), F.col("event_type").alias("pred"))
    return rounded(P.paraphrase_agreement(events, ["user_id"]))


@query
def cost_trace(spark: SparkSession, sf: str) -> DataFrame:
    e = D.table(spark, sf, "events").select("user_id", F.col("value").alias("latency_ms"), (F.col("event_id") % 50).alias("prompt_tokens"), (F.col("event_id") % 7).alias("completion_tokens"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 2 + 1).alias("n_calls"), F.col("event_type").alias("kind"), F.col("event_id").alias("pos"))
    out = P.cost_trace(e, ["user_id"])
    return rounded(out.withColumn("latency_ms", F.round("latency_ms", 1)).withColumn("kinds", F.array_join("kinds", ",")))


@query
def usd_estimate(spark: SparkSession, sf: str) -> DataFrame:
    c = D.table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("prompt_tokens"), F.count("*").alias("completion_tokens"))
    costs = c.select("conv_id", F.when(F.col("conv_id") % 2 == 0, "model-a").otherwise("model-x").alias("model_id"), F.when(F.col("conv_id") % 3 == 0, "weak").otherwise("strong").alias("model_role"), "prompt_tokens", "completion_tokens")
    prices = spark.createDataFrame([("model-a", 0.25, 1.0), ("weak", 0.05, 0.1), ("strong", 1.0, 3.0)], "name string, usd_in double, usd_out double")
    return P.usd(costs, prices).select("conv_id", F.round("usd_est", 6).alias("usd_est"))


@query
def is_correct(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.joined(spark, sf)
    em = T.is_correct(F.concat(F.lit("The "), F.lower("weak_pred"), F.lit(".")), F.col("gold"), F.lit("em"))
    plain = T.is_correct(F.concat(F.lit(" "), F.lower("weak_pred"), F.lit("\n")), F.col("gold"), F.lit("accuracy"))
    return rows.select("vec_id", em.alias("em"), plain.alias("plain"), P.is_mc_analysis(F.when(F.col("is_mc"), "x_mc").otherwise("qa"), F.col("metric")).alias("mc"))


# Routing


def _role(spark: SparkSession, sf: str, role: str) -> DataFrame:
    return D.joined(spark, sf).where(F.col("role") == role)


@query
def joined_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.joined(spark, sf).select("query_id", "role", "source", "is_mc", "gold", "weak_pred", "strong_pred", "weak_ok", "strong_ok", "weak_wrong", "needs_strong", "both_wrong", "has_strong", *R.FEATURES))


@query
def z_vec(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.joined(spark, sf).select("query_id", F.posexplode("z_vec").alias("i", "x")).select("query_id", F.col("i").cast("long").alias("i"), "x"))


@query
def labels_contingency(spark: SparkSession, sf: str) -> DataFrame:
    return D.joined(spark, sf).groupBy("role").agg(F.count_if(F.col("weak_ok") & F.col("strong_ok")).alias("both_right"), F.count_if("needs_strong").alias("needs_strong"), F.count_if("both_wrong").alias("both_wrong"), F.count_if(F.col("weak_ok") & F.col("has_strong") & ~F.col("strong_ok")).alias("strong_only_wrong"))


@query
def slices(spark: SparkSession, sf: str) -> DataFrame:
    return sliced(D.joined(spark, sf)).groupBy("slice").agg(F.count("*").alias("n"))


@query
def s1_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.accuracy_by_slice(_role(spark, sf, "fit")))


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    base = D.probe_base(spark, sf).select("query_id", "is_mc", "gold", "metric")
    return D.probes(spark, sf, "weak").join(base, "query_id").where("role = 'fit'").withColumn("weak_wrong", ~T.is_correct(F.col("pred"), F.col("gold"), F.col("metric")))


@query
def s2_auroc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.signal_auroc(_signals(spark, sf)).withColumn("direction", F.col("direction").cast("long")))


@query
def rank_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.ranked_features(_role(spark, sf, "fit")).withColumn("direction", F.col("direction").cast("long")))


def _order(spark: SparkSession, sf: str) -> DataFrame:
    return R.frozen(R.pooled_order(R.ranked_features(_role(spark, sf, "fit")).withColumn("auroc", F.round("auroc", 9))))


@query
def rank_order(spark: SparkSession, sf: str) -> DataFrame:
    return _order(spark, sf).withColumn("place", F.col("place").cast("long"))


@query
def feature_sets(spark: SparkSession, sf: str) -> DataFrame:
    return R.feature_sets(_order(spark, sf))


@query
def fit_zstats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.feature_stats(_role(spark, sf, "fit")))


Fitted = tuple[DataFrame, DataFrame]


def _fitted(spark: SparkSession, sf: str) -> Fitted:
    """Statistics and feature sets of the fit split, computed once for a query."""
    return R.frozen(R.feature_stats(_role(spark, sf, "fit"))), R.frozen(R.feature_sets(_order(spark, sf)))


def _scored(spark: SparkSession, sf: str, role: str, fitted: Fitted | None = None) -> DataFrame:
    keep = ["query_id", "source", "is_mc", "weak_ok", "strong_ok", "has_strong", "latency_weak", "latency_strong"]
    return R.set_scores(_role(spark, sf, role), *(fitted or _fitted(spark, sf)), keep)


@query
def route_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_scored(spark, sf, "eval").select("set", "query_id", "score"))


def _curve(spark: SparkSession, sf: str, fitted: Fitted | None = None) -> DataFrame:
    return R.frozen(R.swept(_scored(spark, sf, "calib", fitted)))


@query
def sweep_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_curve(spark, sf).select("set", "tau", "tau_tag", "alpha", "accuracy", "pgr", "r_weak", "r_strong"))


def _taus(spark: SparkSession, sf: str, select: str = "cpt80", fitted: Fitted | None = None) -> DataFrame:
    return R.frozen(R.picked(_curve(spark, sf, fitted), select))


@query
def pick_tau_cpt80(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_taus(spark, sf))


@query
def pick_tau_cpt50(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_taus(spark, sf, "cpt50"))


@query
def pick_tau_alpha_max(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_taus(spark, sf, "max_pgr_at_alpha"))


@query
def cpt_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.call_rates(_curve(spark, sf)))


@query
def eval_frozen(spark: SparkSession, sf: str) -> DataFrame:
    fitted = _fitted(spark, sf)
    return rounded(R.evaluated(_scored(spark, sf, "eval", fitted), _taus(spark, sf, fitted=fitted)))


@query
def eval_by_slice(spark: SparkSession, sf: str) -> DataFrame:
    return eval_frozen(spark, sf).where("slice <> 'pooled'").select("set", "slice", "n", "alpha", "accuracy", "pgr")


@query
def path_latency(spark: SparkSession, sf: str) -> DataFrame:
    return eval_frozen(spark, sf).where("slice = 'pooled'").select("set", "mean_path_latency_ms")


@query
def random_escalation(spark: SparkSession, sf: str) -> DataFrame:
    return _role(spark, sf, "eval").select("query_id", R.random_escalation(0.3, 42, "query_id").alias("escalated"))


@query
def escalate(spark: SparkSession, sf: str) -> DataFrame:
    fitted = _fitted(spark, sf)
    rows = _scored(spark, sf, "eval", fitted).join(F.broadcast(_taus(spark, sf, fitted=fitted).select("set", "tau")), "set")
    return rows.select("set", "query_id", R.escalated(F.col("score"), F.col("tau")).alias("escalated"))


@query
def alpha_drag(spark: SparkSession, sf: str) -> DataFrame:
    fitted = _fitted(spark, sf)
    e = R.frozen(R.evaluated(_scored(spark, sf, "eval", fitted), _taus(spark, sf, fitted=fitted)))
    a = lambda s: e.where(F.col("slice") == s).select("set", F.col("alpha").alias(s))
    return rounded(a("pooled").join(a("mc_pooled"), "set").select("set", (F.col("pooled") - F.col("mc_pooled")).alias("drag")))


@query
def curve_markers(spark: SparkSession, sf: str) -> DataFrame:
    fitted = _fitted(spark, sf)
    return rounded(R.markers(R.swept(_scored(spark, sf, "eval", fitted)), _taus(spark, sf, fitted=fitted)))


@query
def curve_plot(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.curve_points(R.swept(_scored(spark, sf, "eval"))).drop("idx"))


@query
def simple_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = _role(spark, sf, "eval")
    rules = R.two_signal_rule(F.col("C_query"), F.col("H"), 1.0 - F.col("p_max"), 0.05, 0.9, 0.5)
    return rows.select("query_id", *[c.alias(k) for k, c in rules.items()], R.weighted_rule({"H": 0.7, "C_query": 0.3}, 0.5).alias("weighted"))


@query
def corr_pearson(spark: SparkSession, sf: str) -> DataFrame:
    rows = _role(spark, sf, "fit")
    pairs = [(a, b) for i, a in enumerate(R.FEATURES) for b in R.FEATURES[i + 1 :]]
    one = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return rounded(one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("x")).select("x.*"))


@query
def corr_spearman(spark: SparkSession, sf: str) -> DataFrame:
    names = ["H", "C_length", "C_query", "margin"]
    long = R.unpivoted(_role(spark, sf, "fit"), ["query_id"], names).withColumnRenamed("value", "s")
    ranks = with_rows_before(long.groupBy("feature", "s").agg(F.count("*").alias("c")), ["feature"]).select("feature", "s", average_rank().alias("r"))
    per_row = long.join(ranks, ["feature", "s"]).groupBy("query_id").agg(*[F.max(F.when(F.col("feature") == n, F.col("r"))).alias(n) for n in names])
    return rounded(per_row.agg(*[F.corr("H", c).alias(f"H_{c}") for c in names[1:]]))


@query
def entropy_tertile_error(spark: SparkSession, sf: str) -> DataFrame:
    rows = tiled(_role(spark, sf, "fit"), 3, "source", "H", "query_id")
    return rounded(rows.groupBy("source", F.col("tile").alias("tertile")).agg(F.count("*").alias("n"), F.avg(F.col("weak_wrong").cast("double")).alias("error")))


@query
def signal_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = _role(spark, sf, "fit")
    q = F.percentile("H", [0.25, 0.5, 0.75])
    return rounded(rows.groupBy("weak_ok").agg(F.avg("H").alias("h_mean"), q.alias("q"), F.avg("p_max").alias("p_mean")).select("weak_ok", "h_mean", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "p_mean"))


@query
def validation_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Joint score and weak-strong entropy gap against the need for the strong model."""
    strong = D.probes(spark, sf, "strong").select("query_id", F.col("H").alias("H_strong"))
    rows = _role(spark, sf, "fit").where("has_strong").join(strong, "query_id")
    long = R.unpivoted(rows.withColumns({"gap": F.col("H") - F.col("H_strong"), "joint": 0.5 * F.col("C_query") + 0.5 * F.col("H")}), ["needs_strong"], ["gap", "joint"])
    return rounded(auroc(long, ["feature"], F.col("needs_strong"), F.col("value")))


@query
def validation_joint(spark: SparkSession, sf: str) -> DataFrame:
    """The joint score of standardised complexity and entropy against the need for the strong model."""
    fit = _role(spark, sf, "fit").where("has_strong")
    stats = fit.agg(*[f(c).alias(f"{n}_{c}") for c in ("C_query", "H") for n, f in (("m", F.avg), ("s", F.stddev_pop))])  # one row
    z = lambda c: (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")
    rows = fit.crossJoin(F.broadcast(stats)).withColumn("joint", 0.5 * z("C_query") + 0.5 * z("H"))
    return rounded(auroc(rows, ["source"], F.col("needs_strong"), F.col("joint")).select("source", "n", "n_pos", "auroc"))


@query
def u_h_redundancy(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of disagreement and entropy over the same answers."""
    events = D.table(spark, sf, "events").select("user_id", F.col("event_id").alias("pos"), F.col("event_type").alias("answer"))
    u = P.paraphrase_agreement(events, ["user_id"], "answer", "pos").select("user_id", "U")
    return rounded(P.answer_clusters(events, ["user_id"]).select("user_id", "H").join(u, "user_id").agg(F.count("*").alias("n"), F.corr("U", "H").alias("r")))


@query
def level_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Spearman's correlation of complexity with a level of difficulty."""
    names = ["C_length", "C_linguistic", "C_query"]
    rows = _role(spark, sf, "fit").withColumn("level", (F.col("vec_id") % 4).cast("double"))
    long = R.unpivoted(rows, ["query_id"], [*names, "level"]).withColumnRenamed("value", "s")
    ranks = with_rows_before(long.groupBy("feature", "s").agg(F.count("*").alias("c")), ["feature"]).select("feature", "s", average_rank().alias("r"))
    per_row = long.join(ranks, ["feature", "s"]).groupBy("query_id").agg(*[F.max(F.when(F.col("feature") == n, F.col("r"))).alias(n) for n in (*names, "level")])
    return rounded(per_row.agg(*[F.corr("level", c).alias(c) for c in names]))


@query
def weak_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy of either model as the signal for a wrong weak answer."""
    strong = D.probes(spark, sf, "strong").select("query_id", F.col("H").alias("H_strong"))
    long = R.unpivoted(_role(spark, sf, "fit").join(strong, "query_id"), ["weak_wrong"], ["H", "H_strong"])
    return rounded(auroc(long, ["feature"], F.col("weak_wrong"), F.col("value")))


# Checks and storage


@query
def verify_issues(spark: SparkSession, sf: str) -> DataFrame:
    strong = D.probes(spark, sf, "strong")
    twice = strong.unionByName(strong.where("source = 'src1'"))
    return V.issues(twice, D.probe_base(spark, sf).select("query_id", "source"), "strong", backend="mock", manifest_count=7)


@query
def join_check(spark: SparkSession, sf: str) -> DataFrame:
    return V.join_check(D.joined(spark, sf))


@query
def fit_violations(spark: SparkSession, sf: str) -> DataFrame:
    """A transform that was fitted on one source of all roles."""
    rows = D.probe_base(spark, sf).select("query_id", "role", "source")
    return G.fit_violations(rows.where("source = 'src1'"), rows)


@query
def incomplete_rows(spark: SparkSession, sf: str) -> DataFrame:
    return R.incomplete(D.joined(spark, sf))


@query
def model_roles(spark: SparkSession, sf: str) -> DataFrame:
    return V.model_roles(D.probes(spark, sf, "weak").unionByName(D.probes(spark, sf, "strong")))


@query
def latest_backup_prune(spark: SparkSession, sf: str) -> DataFrame:
    """Versions (orders) of a table (customer) that pruning deletes: all but the newest ones."""
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    rows = D.table(spark, sf, "orders").withColumn("age", F.row_number().over(newest))
    return rows.where(F.col("age") > L.BACKUPS_KEPT).select("o_custkey", "o_orderkey", F.col("age").cast("long").alias("age"))


@query
def joined_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The join where each weak probe has an older record with another answer."""
    base = D.probe_base(spark, sf)
    weak = D.probes(spark, sf, "weak")
    both = weak.withColumn("pred", F.lit("Z")).withColumn("ordinal", F.lit(0)).unionByName(weak.withColumn("ordinal", F.lit(1)))
    phi = base.select("query_id", "C_length", "C_density", "C_atypical", "C_linguistic", "C_query")
    rows = R.joined_rows(base.select("query_id", "source", "role", "task_type", "metric", "gold", "is_mc"), phi, both, D.probes(spark, sf, "strong"))
    return rows.select("query_id", "weak_pred", "strong_pred", "weak_ok", "needs_strong")


@query
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    old = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderstatus").alias("state"))
    new = D.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(F.max("l_linestatus").alias("state"))
    return store.upserted(old, new)


@query
def resume_todo(spark: SparkSession, sf: str) -> DataFrame:
    done = D.table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("query_id")).distinct()
    return store.todo(D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id")), done)


@query
def last_duplicate_wins(spark: SparkSession, sf: str) -> DataFrame:
    return C.last_of(D.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], F.col("o_orderkey"))
