"""Command line: corpus, features, probes, analysis, routing, restore.

Folders are URIs that Spark reads. --config names a YAML or JSON file; flags win over it.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lexicon as L
from .functions import text as T
from .operators import corpus as C
from .operators import features as X
from .operators import geometry as G
from .operators import probe as P
from .operators import quality as V
from .plans import routing as R
from .sources import store

CORPUS = "query_id string, source string, config string, hf_split string, role string, task_type string, prompt string, gold string, metric string, text_hash string"
PROBE = (
    "query_id string, model_id string, model_role string, source string, role string, probe string, H double, p_max double, pred string, margin double, top2_mass double, "
    "U double, agreement double, k long, mode string, latency_ms double, prompt_tokens long, completion_tokens long, total_tokens long, n_calls long, usd_est double"
)
#: Raw rows of the datasets, staged as {raw}/{dataset}/{split}.jsonl.
RAW = {
    "arc_challenge": "id string, question string, labels array<string>, texts array<string>, answer_key string",
    "hotpotqa": "id string, question string, answer string, level string, type string, titles array<string>, sentences array<array<string>>, supporting array<string>",
    "mmlu": "row_index long, subject string, question string, choices array<string>, answer string",
}
PHI = "query_id string, role string, source string, C_length double, C_density double, C_atypical double, C_linguistic double, C_query double"
# Experiments and the models behind them.
POOL = {
    "primary": {"weak": "llama-3.1-8b-instruct", "strong": "llama-3.1-70b-instruct"},
    "ablation": {"weak": "qwen2.5-7b-instruct", "strong": "llama-3.1-70b-instruct"},
    "local_strong": {"weak": "llama-3.1-8b-instruct", "strong": "qwen2.5-32b-instruct"},
    "local_strong_gemma": {"weak": "llama-3.1-8b-instruct", "strong": "gemma-2-27b-it"},
}


def _config(spark: SparkSession, a: argparse.Namespace) -> dict:
    return store.load_config(spark, a.config) if a.config else {}


def _corpus(a: argparse.Namespace) -> str:
    return getattr(a, "corpus", None) or f"{a.base}/corpus"


def _table(spark: SparkSession, a: argparse.Namespace, role: str, model_role: str) -> store.VersionedTable:
    return store.VersionedTable(spark, store.signals_path(spark, getattr(a, "signals", None) or f"{a.base}/probes", role, model_role), PROBE)


def _joined(spark: SparkSession, a: argparse.Namespace, role: str) -> DataFrame:
    rows = store.load_corpus(spark, _corpus(a), CORPUS).where(F.col("role") == role)
    phi = spark.read.schema(PHI).parquet(f"{a.base}/phi").drop("role", "source")
    return R.joined_rows(rows, phi, *(_table(spark, a, role, m).read() for m in ("weak", "strong"))).withColumn("is_mc", P.is_mc_analysis(F.col("task_type"), F.col("metric")))


def corpus(spark: SparkSession, a: argparse.Namespace) -> None:
    """With a config, the corpus is built from staged rows; it is checked in any case."""
    out = a.out or _corpus(a)
    config = _config(spark, a)
    if config:
        config = C.smoke(config) if a.smoke else config
        raw = config.get("raw_dir") or f"{a.base}/raw"
        rows = C.built(config, lambda name, split: store.read_jsonl(spark, f"{raw}/{name}/{split}.jsonl", RAW[name]))
        C.assert_sound(rows)
        for role in ("fit", "calib", "eval"):
            store.write_jsonl(rows.where(F.col("role") == role), f"{out}/queries_{role}.jsonl")
    rows = store.load_corpus(spark, out, CORPUS, limit=8 if a.smoke and not config else None)
    C.assert_sound(rows)
    manifest = {"version": config.get("version"), "seed": config.get("seed"), "counts": {r["role"]: r["n"] for r in rows.groupBy("role").agg(F.count("*").alias("n")).collect()}, "fingerprints": {r["role"]: r["fingerprint"] for r in C.fingerprints(rows).collect()}}
    store.write_artifact(spark, f"{out}/corpus_manifest.json", manifest)


def complexity(spark: SparkSession, a: argparse.Namespace) -> None:
    """Geometry comes from --embeddings (Parquet: query_id, v) or from the stand-in encoder."""
    weights = _config(spark, a).get("weights") or L.COMPLEXITY_WEIGHTS
    out = a.artifacts or a.base
    rows = X.prompt_features(store.load_corpus(spark, _corpus(a), CORPUS, limit=a.limit))
    blocks = {"structural": X.STRUCTURAL, "linguistic_cues": X.LINGUISTIC}
    fit_ids = rows.where("role = 'fit'").select("query_id")
    if not a.no_geometry:
        vectors = spark.read.parquet(a.embeddings) if a.embeddings else G.encode_texts(rows, G.HashingEncoder())
        fit = vectors.join(fit_ids, "query_id", "left_semi")
        G.assert_fit_only(fit, rows)
        rows = rows.join(G.atypicality(vectors, fit), "query_id", "left")
        blocks["embedding_geometry"] = X.GEOMETRY
    flat = X.flattened(rows, "query_id", blocks)
    stats = R.frozen(X.zstats(flat.join(fit_ids, "query_id", "left_semi")))
    scores = X.composed(X.zscored(flat, stats, "query_id"), "query_id", weights)
    rows.select("query_id", "role", "source").join(scores, "query_id", "left").write.mode("overwrite").parquet(f"{out}/phi")
    store.write_artifact(spark, f"{out}/zscore.json", {"mean": {r["feature"]: r["mean"] for r in stats.collect()}, "std": {r["feature"]: r["std"] for r in stats.collect()}, "weights": weights})


def query_model(spark: SparkSession, a: argparse.Namespace) -> None:
    """Probes in parts of about --save-every rows; each part is stored before the next one begins, so that a new run goes on after the last."""
    config = _config(spark, a)
    if a.backend != "mock":
        raise ValueError(f"no backend {a.backend!r} here: give a Backend to operators.probe.probe_with")
    paraphrase = config.get("paraphrase", {})
    k = int(paraphrase.get("k", 3)) if paraphrase.get("enabled", True) and not a.no_paraphrase else 1
    n_samples = int(config.get("hotpot", {}).get("n_samples", 3))
    prices = [(name, float(p.get("input_per_mtok", 0)), float(p.get("output_per_mtok", 0))) for name, p in config.get("pricing", {}).items()]
    price_rows = spark.createDataFrame(prices, "name string, usd_in double, usd_out double")
    rows = store.load_corpus(spark, _corpus(a), CORPUS, limit=a.limit)
    if a.sources:
        rows = rows.where(F.col("source").isin(*a.sources))
    for role in a.roles:
        for model_role, model in P.model_pool(POOL, a.experiment, a.model_roles):
            table = store.VersionedTable(spark, f"{a.out or a.base + '/probes'}/{role}_{model_role}", PROBE)
            own = rows.where(F.col("role") == role)
            if not (a.no_resume or a.replace_all):
                own = store.todo(own, table.read())
            n = own.count()
            parts = max(1, -(-n // a.save_every)) if a.save_every else 1
            part_of = F.pmod(F.xxhash64("query_id"), F.lit(parts))
            left, first = own.select(*own.columns), True
            for part in range(parts):
                new = P.stand_in_records(left.where(part_of == part), model, model_role, k, n_samples, price_rows if prices else None)
                if not prices:
                    new = new.withColumn("usd_est", F.lit(None).cast("double"))
                table.write(new) if a.replace_all and first else table.upsert(new)
                first = False
                if a.progress_every and ((part + 1) % a.progress_every == 0 or part + 1 == parts):
                    print(progress_line(table.read(), role, model_role, part + 1, parts))


def progress_line(done: DataFrame, role: str, model_role: str, part: int, parts: int) -> str:
    """Averages over the stored probes."""
    r = done.agg(F.count("*").alias("n"), F.avg(F.coalesce("latency_ms", F.lit(0.0))).alias("ms"), F.avg(F.coalesce("total_tokens", F.lit(0))).alias("tok")).first()
    return f"{role}/{model_role} {part}/{parts}: {r['n']} stored, avg {r['ms'] or 0:.0f} ms, {r['tok'] or 0:.0f} tokens"


def analyze(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = store.load_corpus(spark, _corpus(a), CORPUS).where(F.col("role") == a.role)
    signals = _table(spark, a, a.role, a.model_role).read().withColumn("probs", F.lit(None).cast("map<string,double>"))
    manifest = store.load_config(spark, a.manifest) if a.manifest else {}
    found = V.issues(signals, rows, a.model_role, backend=manifest.get("backend"), manifest_count=manifest.get("counts", {}).get(a.role))
    found.show(100, False)
    report: dict = {"role": a.role, "model_role": a.model_role, "model_roles": {r["model_role"]: r["n"] for r in V.model_roles(signals).collect()}, "issues": [r.asDict() for r in found.collect()]}

    def said(code: int) -> int:
        if a.json_out:
            store.write_artifact(spark, a.json_out, report)
        return code

    sound = not report["issues"]
    if a.verify_only:
        return said(0 if sound else 1)
    if not sound and not a.skip_verify:
        return said(1)
    joined = rows.join(signals.drop("source", "role"), "query_id").withColumns({"is_mc": P.is_mc_analysis(F.col("task_type"), F.col("metric"))})
    joined = joined.withColumn("weak_ok", T.is_correct(F.col("pred"), F.col("gold"), F.col("metric"))).withColumns({"weak_wrong": ~F.col("weak_ok"), "perplexity_H": F.exp("H"), "inv_p_max": 1 / F.col("p_max"), "surprisal": -F.log("p_max")})
    by_slice = R.accuracy_by_slice(joined)
    auroc = V.signal_auroc(joined).where("true" if a.s2_all_signals else "representative").orderBy("slice", "signal")
    by_slice.show(100, False)
    auroc.show(200, False)
    report |= {"accuracy": [r.asDict() for r in by_slice.collect()], "auroc": [r.asDict() for r in auroc.collect()]}
    return said(0)


def route(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = _joined(spark, a, a.role)
    if a.step == "join-check":
        V.join_check(rows).show()
        return 0
    fit = rows if a.role == "fit" else _joined(spark, a, "fit")
    ranks = R.frozen(R.ranked_features(fit))
    sets = R.frozen(R.feature_sets(R.pooled_order(ranks)))
    if a.step == "rank":
        store.write_artifact(spark, f"{a.base}/rank_{a.role}.json", [r.asDict() for r in ranks.collect()])
        return 0
    R.assert_complete(rows)
    keep = ["query_id", "source", "is_mc", "weak_ok", "strong_ok", "has_strong", "latency_weak", "latency_strong"]
    scores = R.set_scores(rows, R.frozen(R.feature_stats(fit)), sets, keep)
    if a.sets:
        scores = scores.where(F.col("set").isin(*a.sets))
    if a.step == "sweep":
        curve = R.frozen(R.swept(scores))
        R.picked(curve, a.select, a.alpha_max).write.mode("overwrite").parquet(f"{a.base}/tau_star")
        store.write_jsonl(curve, f"{a.base}/curves_{a.role}.jsonl")
        return 0
    taus = R.frozen(spark.read.parquet(f"{a.base}/tau_star"))
    if a.step == "eval":
        store.write_jsonl(R.evaluated(scores, taus), f"{a.base}/eval_{a.role}.jsonl")
    else:
        curve = R.frozen(R.swept(scores))
        store.write_jsonl(R.curve_points(curve), f"{a.out or a.base}/curves_{a.role}.jsonl")
        store.write_jsonl(R.markers(curve, taus), f"{a.out or a.base}/markers_{a.role}.jsonl")
    return 0


def restore(spark: SparkSession, a: argparse.Namespace) -> None:
    table = store.VersionedTable(spark, f"{a.base}/probes/{a.stem}", PROBE)
    if a.list:
        print("\n".join(table.backups()))
    else:
        print(table.restore(a.backup, a.dry_run))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="escalade")
    p.add_argument("--base", default=".", help="folder (any URI that Spark reads) of corpus, features, probes and results")
    sub = p.add_subparsers(dest="command", required=True)
    def command(name: str, run: object, *flags: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for flag in flags:
            c.add_argument(flag)
        c.set_defaults(run=run)
        return c

    c = command("corpus", corpus, "--config", "--out")
    c.add_argument("--smoke", action="store_true")
    c = command("complexity", complexity, "--config", "--corpus", "--artifacts", "--embeddings")
    c.add_argument("--limit", type=int)
    c.add_argument("--no-geometry", action="store_true")
    c = command("query-model", query_model, "--config", "--corpus", "--out")
    c.add_argument("--experiment", choices=list(POOL), default="primary")
    c.add_argument("--backend", default="mock")
    c.add_argument("--mock", dest="backend", action="store_const", const="mock")
    c.add_argument("--roles", nargs="+", default=["fit", "calib", "eval"])
    c.add_argument("--sources", nargs="+")
    c.add_argument("--model-roles", nargs="+")
    c.add_argument("--limit", type=int)
    c.add_argument("--save-every", type=int, default=10_000)
    c.add_argument("--progress-every", type=int, default=1, help="in parts")
    for flag in ("--replace-all", "--no-resume", "--no-paraphrase"):
        c.add_argument(flag, action="store_true")
    c = command("query-model-analyze", analyze, "--signals", "--corpus", "--manifest", "--json-out")
    c.add_argument("--role", default="fit")
    c.add_argument("--model-role", default="weak")
    for flag in ("--verify-only", "--skip-verify", "--s2-all-signals"):
        c.add_argument(flag, action="store_true")
    c = sub.add_parser("query-model-restore")
    c.add_argument("--stem", required=True)
    c.add_argument("--list", action="store_true")
    c.add_argument("--backup")
    c.add_argument("--dry-run", action="store_true")
    c.set_defaults(run=restore)
    c = sub.add_parser("route")
    c.add_argument("step", choices=["rank", "sweep", "eval", "curves", "join-check"])
    c.add_argument("--role", default=None)
    c.add_argument("--select", default="cpt80")
    c.add_argument("--alpha-max", type=float, default=0.25)
    c.add_argument("--sets", nargs="+")
    c.add_argument("--out")
    c.set_defaults(run=route)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "route" and a.role is None:
        a.role = {"rank": "fit", "sweep": "calib", "eval": "eval", "curves": "eval", "join-check": "fit"}[a.step]
    return a.run(SparkSession.builder.appName("escalade").getOrCreate(), a) or 0


if __name__ == "__main__":
    sys.exit(main())
