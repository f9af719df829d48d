import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from escalade import catalog
from escalade.functions import scores as S
from escalade.functions import text as T
from escalade.operators import probe as P
from escalade.operators.ranking import auroc, sliced
from escalade.plans import routing as R
from escalade.sources import store

FAST = ["corpus_rows", "split_fingerprints", "text_leakage", "mc_prompt_parse", "hotpot_prompt_split", "sample_stratified", "feat_linguistic", "mc_scores_weak", "cluster_entropy", "paraphrase_u", "lof_score", "rank_features", "sweep_curve", "verify_issues", "last_duplicate_wins"]


def plain(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 6) + 0.0 if isinstance(x, float) else x for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", FAST)
def test_same_rows_in_sql(spark, sf, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns)
    r = con.execute(catalog.oracle_sql()[name])
    assert plain(got) == plain(pd.DataFrame(r.fetchall(), columns=[c[0] for c in r.description]))


def test_entry_names():
    assert catalog.FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_normalized_answer(spark):
    assert one(spark, a=T.normalized_answer(F.lit("The Eiffel-Tower, a landmark!")))["a"] == "eiffeltower landmark"
    r = one(spark, a=T.is_correct(F.lit("The Rome."), F.lit("rome"), F.lit("em")), b=T.is_correct(F.lit(" b "), F.lit("B"), F.lit("accuracy")))
    assert r["a"] and r["b"]


def test_paraphrases_take_the_whole_text(spark, sf):
    rows = catalog.queries()["paraphrase_surfaces"](spark, sf).collect()
    texts = {(r["conv_id"], r["turn"]): r["text"].strip() for r in spark.read.parquet(f"{sf}/conversations.parquet").collect() if r["text"] is not None}
    assert len(rows) >= 3 * len(texts) > 0
    assert all(r["surface"].endswith(texts[r["conv_id"], r["turn"]]) for r in rows if r["surface"] is not None)


def test_distribution_scores(spark):
    def scored(**p):
        m = F.create_map(*[F.lit(x) for kv in p.items() for x in kv])
        return one(spark, s=S.distribution_scores(m))["s"]

    s = scored(A=0.05, B=0.81, C=0.10, D=0.04)
    assert s["pred"] == "B" and abs(s["H"] - 0.6794841913375107) < 1e-12 and abs(s["margin"] - 0.71) < 1e-12
    assert scored(A=0.4, B=0.2, C=0.4)["pred"] == "C"
    zero = scored(A=0.0, B=0.0, C=0.0, D=0.0)
    assert zero["pred"] == "D" and abs(zero["H"] - math.log(4)) < 1e-12


def test_clusters_first_seen(spark):
    rows = spark.createDataFrame([(1, 0, "Paris"), (1, 1, "the paris"), (1, 2, "Rome"), (2, 0, "Rome"), (2, 1, "Paris")], "k long, pos long, answer string")
    got = {r["k"]: r for r in P.answer_clusters(rows, ["k"]).collect()}
    assert got[1]["pred"] == "Paris" and abs(got[1]["H"] - 0.6365141682948128) < 1e-12 and got[1]["n_clusters"] == 2
    assert got[2]["pred"] == "Rome" and got[2]["margin"] == 0


@pytest.mark.parametrize("tokens,w,want", [("abac", 2, 1.0), ("abac", 3, 5 / 6), ("abac", 10, 0.75), ("", 3, None)])
def test_mattr(spark, tokens, w, want):
    got = spark.createDataFrame([(list(tokens),)], "t array<string>").select(T.mattr(F.col("t"), w).alias("m")).first()["m"]
    assert got is None if want is None else abs(got - want) < 1e-12


@pytest.mark.parametrize("y,s,want", [([0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8], 0.75), ([0, 1, 1], [1.0, 1.0, 2.0], 0.75), ([1, 1], [1.0, 2.0], None)])
def test_auroc(spark, y, s, want):
    got = auroc(spark.createDataFrame(list(zip(y, s, strict=True)), "y int, s double"), [], F.col("y"), F.col("s")).first()["auroc"]
    assert math.isnan(got) if want is None else abs(got - want) < 1e-12


def test_slices_without_mixture(spark):
    rows = spark.createDataFrame([("a", True), ("b", True)], "source string, is_mc boolean")
    assert {r["slice"] for r in sliced(rows).collect()} == {"pooled", "a", "b"}


def test_sweep_and_pick(spark):
    rows = spark.createDataFrame([("S", float(i), w, s, True) for i, (w, s) in enumerate([(True, True), (True, True), (False, True), (False, False)])], "set string, score double, weak_ok boolean, strong_ok boolean, has_strong boolean")
    curve = R.swept(rows)
    ends = {r["tau_tag"]: r for r in curve.where("tau is null").collect()}
    assert ends["always_weak"]["pgr"] == 0 and ends["always_strong"]["pgr"] == 1
    best = R.picked(curve).first()
    assert abs(best["tau"] - 1.02) < 1e-9 and best["alpha"] == 0.5 and best["pgr"] == 1 and best["cpt80"] == 0.5 and not best["fallback"]
    alphas = [r["alpha"] for r in curve.orderBy("idx").where("tau_tag = 'threshold'").collect()]
    assert alphas == sorted(alphas, reverse=True)


def test_unknown_score_stays_weak(spark):
    r = one(spark, a=R.escalated(F.lit(float("nan")), F.lit(0.0)), b=R.escalated(F.lit(None).cast("double"), F.lit(0.0)), c=S.gap_recovered(F.lit(0.5), F.lit(0.5), F.lit(0.5)))
    assert not r["a"] and not r["b"] and math.isnan(r["c"])


def test_versioned_table(spark, tmp_path):
    t = store.VersionedTable(spark, f"file://{tmp_path}/t", "query_id long, v string", keep=2)
    assert t.read().count() == 0
    t.write(spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "query_id long, v string"))
    for _ in range(2):  # twice the same is once
        t.upsert(spark.createDataFrame([(2, "b"), (4, "b")], "query_id long, v string"))
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "a"), (2, "b"), (3, "a"), (4, "b")]
    oldest = t.backups()[-1]
    t.restore(oldest)
    assert t.read().where("v = 'b'").count() == 0
    for _ in range(3):
        t.upsert(t.read().limit(0))
    assert len(t.backups()) == 2


def test_upsert_takes_all_keys(spark, sf):
    want = {r["o_orderkey"]: r["o_orderstatus"] for r in spark.read.parquet(f"{sf}/orders.parquet").collect()}
    new: dict = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        new[r["l_orderkey"]] = max(new.get(r["l_orderkey"], ""), r["l_linestatus"])
    got = [tuple(r) for r in catalog.queries()["upsert"](spark, sf).collect()]
    assert want.keys() - new.keys() and sorted(got) == sorted((want | new).items())


def test_complexity_has_the_compression_term(spark, sf):
    import zlib

    from escalade.functions import lexicon as L

    texts = {r["doc_id"]: r["prompt"] or "" for r in catalog.Q.D.corpus(spark, sf).collect()}
    ratio = {d: len(zlib.compress(t.encode(), L.ZLIB_LEVEL)) / len(t.encode()) for d, t in texts.items() if t}
    fit = [x for d, x in ratio.items() if d % 10 < 5]
    mean = sum(fit) / len(fit)
    std = math.sqrt(sum((x - mean) ** 2 for x in fit) / len(fit))
    before, got = ({r["doc_id"]: r for r in catalog.queries()[n](spark, sf).collect()} for n in ("complexity_scores", "complexity_compressed"))
    assert got.keys() == texts.keys()
    for d, r in got.items():
        z = (ratio[d] - mean) / std if d in ratio else 0.0
        assert abs(r["C_density"] - (before[d]["C_density"] - z)) < 3e-6 and abs(r["C_query"] - (before[d]["C_query"] - z / 4)) < 3e-6


def test_stream_resumes(spark, tmp_path):
    from escalade.streaming.checkpoint import probe_stream

    t = store.VersionedTable(spark, f"file://{tmp_path}/p", "query_id long, v string")
    t.write(spark.createDataFrame([(0, "old")], "query_id long, v string"))
    spark.range(5).select(F.col("id").alias("query_id")).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("query_id long").parquet(f"{tmp_path}/in")
    probe_stream(source, t, lambda b: b.withColumn("v", F.lit("new")), f"{tmp_path}/ck").awaitTermination()
    assert sorted(tuple(r) for r in t.read().collect()) == [(0, "old"), *[(i, "new") for i in range(1, 5)]]


def _cli(*argv):
    from escalade import cli

    return cli.main([str(x) for x in argv])


def _staged(base):
    """Raw rows of the three datasets."""
    import json

    def put(name, split, rows):
        (base / "raw" / name).mkdir(parents=True, exist_ok=True)
        (base / "raw" / name / f"{split}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))

    arc = lambda s, n: [{"id": f"{s}{i}", "question": f"Which is number {i} of {s}?", "labels": ["1", "2", "3"], "texts": [f"one {i}", f"two {s}", "three"], "answer_key": str(i % 3 + 1)} for i in range(n)]
    hop = lambda s, n: [{"id": f"{s}{i}", "question": f"Who wrote book {i} in {s}?", "answer": ["paris", "rome"][i % 2], "level": ["easy", "hard"][i % 2], "type": "bridge", "titles": ["T", "U"], "sentences": [[f"A {i}."], ["B."]], "supporting": ["T"]} for i in range(n)]
    for s, n in (("train", 40), ("validation", 20), ("test", 30)):
        put("arc_challenge", s, arc(s, n))
    for s, n in (("train", 60), ("validation", 30)):
        put("hotpotqa", s, hop(s, n))
    for s, n in (("validation", 24), ("test", 36)):
        put("mmlu", s, [{"row_index": i, "subject": ["law", "math", "art"][i % 3], "question": f"{s} question {i}?", "choices": [f"w{i}", "x", "y", "z"], "answer": str(i % 4)} for i in range(n)])
    roles = lambda **k: {r: dict(zip(("split", "max_examples"), v, strict=True)) for r, v in k.items()}
    config = {
        "version": "v", "seed": 7, "pricing": {"weak": {"input_per_mtok": 1.0, "output_per_mtok": 2.0}}, "paraphrase": {"k": 2},
        "datasets": {
            "arc_challenge": {"roles": roles(fit=("train", 30), calib=("validation", None), eval=("test", 25))}, "hotpotqa": {"context_policy": "full_context", "roles": roles(fit=("train", 30), calib=("train", 10), eval=("validation", 25))},
            "mmlu": {"subjects": ["law", "math"], "roles": {"fit": {"split": "validation", "per_subject": None}, "eval": {"split": "test", "per_subject": 5}}},
        },
    }
    (base / "config.json").write_text(json.dumps(config))


def test_command_line(spark, tmp_path, capsys):
    import json

    _staged(tmp_path)
    base, config = f"file://{tmp_path}", f"file://{tmp_path}/config.json"
    _cli("--base", base, "corpus", "--config", config)
    counts = json.loads((tmp_path / "corpus/corpus_manifest.json").read_text())["counts"]
    assert counts == {"fit": 30 + 30 + 16, "calib": 20 + 10, "eval": 25 + 25 + 10}
    rows = spark.read.json(f"{tmp_path}/corpus/queries_*.jsonl")
    hop = rows.where("source = 'hotpotqa' and hf_split = 'train'")
    assert hop.select("raw_id").distinct().count() == 40
    _cli("--base", base, "corpus", "--config", config, "--smoke", "--out", f"{base}/small")
    assert max(json.loads((tmp_path / "small/corpus_manifest.json").read_text())["counts"].values()) <= 32
    _cli("--base", base, "complexity")
    phi = {r["query_id"]: r for r in spark.read.parquet(f"{tmp_path}/phi").collect()}
    assert len(phi) == sum(counts.values()) and len({r["C_atypical"] for r in phi.values()}) > 10
    _cli("--base", base, "query-model", "--config", config, "--save-every", 45)
    said = [x for x in capsys.readouterr().out.splitlines() if x.startswith("fit/weak")]
    assert len(said) == 2 and "76 stored" in said[-1]
    probes = store.VersionedTable(spark, f"{base}/probes/fit_weak", "query_id string, U double, k long, n_calls long, prompt_tokens long, completion_tokens long, usd_est double").read().collect()
    assert len(probes) == 76 and {(r["U"], r["k"], r["n_calls"]) for r in probes} == {(0.0, 2, 3)}
    assert all(abs(r["usd_est"] - (r["prompt_tokens"] + 2 * r["completion_tokens"]) / 1e6) < 1e-8 for r in probes)
    versions = len(store.VersionedTable(spark, f"{base}/probes/fit_weak", "query_id string").versions())
    _cli("--base", base, "query-model", "--config", config, "--roles", "fit", "--model-roles", "weak", "--no-paraphrase", "--limit", 5)
    assert len(store.VersionedTable(spark, f"{base}/probes/fit_weak", "query_id string").versions()) >= min(versions, 2)
    assert _cli("--base", base, "query-model-analyze", "--verify-only", "--json-out", f"{base}/report.json") == 0
    report = json.loads((tmp_path / "report.json").read_text())
    assert report["model_roles"] == {"weak": 76} and report["issues"] == []
    assert _cli("--base", base, "query-model-analyze", "--json-out", f"{base}/report.json") == 0
    assert {r["slice"] for r in json.loads((tmp_path / "report.json").read_text())["accuracy"]} >= {"pooled", "arc", "hotpotqa", "mmlu"}
    for step in ("rank", "sweep", "eval", "curves", "join-check"):
        assert _cli("--base", base, "route", step) == 0
    sets = {r["set"] for r in spark.read.json(f"{tmp_path}/eval_eval.jsonl").collect()}
    assert "S_H" in sets and (tmp_path / "rank_fit.json").exists()
    _cli("--base", base, "query-model-restore", "--stem", "fit_weak", "--dry-run")


def test_first_rows_are_those_of_the_file(spark, tmp_path):
    for role in ("fit", "calib", "eval"):
        (tmp_path / f"queries_{role}.jsonl").write_text("".join(f'{{"query_id": "{role}{i}", "role": "{role}"}}\n' for i in range(20, 0, -1)))
    got = store.load_corpus(spark, str(tmp_path), "query_id string, role string", limit=3)
    assert sorted(r["query_id"] for r in got.collect()) == sorted(f"{r}{i}" for r in ("fit", "calib", "eval") for i in (20, 19, 18))


@pytest.mark.parametrize("name", ["probe_records", "complexity_geometry", "corr_spearman", "entropy_tertile_error", "upsert", "resume_todo", "paraphrase_surfaces", "fit_violations", "joined_last_wins", "random_escalation", "latest_backup_prune", "knn_similarity", "lof_score"])
def test_sql(spark, sf, name):
    import duckdb

    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings conversations labels".split():
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(catalog.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    plain = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    got = catalog.queries()[name](spark, sf)
    assert sorted(got.columns) == columns
    key = lambda r: [str(x) for x in r]
    assert sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=key) == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=key)
