"""Corpus rows, dataset builders, samples, splits and checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def corpus_rows(rows: DataFrame) -> DataFrame:
    """Canonical rows from source, config, hf_split, role, task_type, prompt, gold, metric, raw_id (meta columns follow)."""
    extra = [c for c in rows.columns if c not in ("source", "config", "hf_split", "role", "task_type", "prompt", "gold", "metric", "raw_id")]
    prompt, gold = T.trim(F.col("prompt")), T.trim(F.col("gold"))
    return rows.select(
        T.query_id(F.col("source"), F.col("config"), F.col("hf_split"), F.col("raw_id")).alias("query_id"), "source", "config", "hf_split", "role", "task_type",
        prompt.alias("prompt"), gold.alias("gold"), "metric", T.text_hash(F.concat(prompt, F.lit("||"), gold)).alias("text_hash"), F.col("raw_id").cast("string").alias("raw_id"), *extra,
    )


def relabelled_choices(labels: Column, texts: Column, key: Column) -> Column:
    """struct(texts, gold): choices take letters by position; the key by its place, else itself if it is one of the letters, else A."""
    at = F.array_position(labels, key)
    letters = F.transform(F.sequence(F.lit(0), F.size(texts) - 1), lambda i: F.char(i + 65))
    return F.struct(texts.alias("texts"), F.when(at > 0, F.char(at + 64)).when(F.array_contains(letters, key), key).otherwise(F.lit("A")).alias("gold"))


def letter_gold(answer: Column) -> Column:
    """Digits become letters, other answers stay."""
    return F.when(F.regexp_like(answer, F.lit(r"^\d+$")), F.char(answer.try_cast("int") + 65)).otherwise(answer)


def paragraphs(titles: Column, sentences: Column, supporting: Column, policy: str) -> Column:
    """Context paragraphs `title: text` by policy: full_context, gold_only or question_only."""
    if policy == "question_only":
        return F.array().cast("array<string>")
    pairs = F.zip_with(titles, sentences, lambda t, s: F.struct(t.alias("t"), s.alias("s")))
    if policy == "gold_only":
        pairs = F.filter(pairs, lambda x: F.array_contains(supporting, x["t"]))
    return F.transform(pairs, lambda x: F.concat(x["t"], F.lit(": "), T.trim(F.array_join(F.transform(x["s"], T.trim), " "))))


def context_prompt(paras: Column, q: Column) -> Column:
    return T.free_prompt(F.array_join(paras, "\n\n"), q)


def arc_rows(raw: DataFrame, role: str, split: str, config: str = "ARC-Challenge") -> DataFrame:
    """raw: id, question, labels, texts, answer_key."""
    fixed = raw.withColumn("c", relabelled_choices(F.col("labels"), F.col("texts"), F.col("answer_key")))
    return corpus_rows(fixed.select(F.lit("arc").alias("source"), F.lit(config).alias("config"), F.lit(split).alias("hf_split"), F.lit(role).alias("role"), F.lit("science_mc").alias("task_type"), T.mc_prompt(F.col("question"), F.col("c.texts")).alias("prompt"), F.col("c.gold").alias("gold"), F.lit("accuracy").alias("metric"), F.col("id").alias("raw_id"), F.size("texts").alias("n_choices")))


def hotpot_rows(raw: DataFrame, role: str, split: str, policy: str = "full_context", config: str = "distractor") -> DataFrame:
    """raw: id, question, answer, level, type, titles, sentences, supporting. The test split has no answers and is refused."""
    if split == "test":
        raise ValueError("the test split has no answers")
    with_paras = raw.withColumn("p", paragraphs(F.col("titles"), F.col("sentences"), F.col("supporting"), policy))
    return corpus_rows(with_paras.select(F.lit("hotpotqa").alias("source"), F.lit(config).alias("config"), F.lit(split).alias("hf_split"), F.lit(role).alias("role"), F.lit("multi_hop_qa").alias("task_type"), context_prompt(F.col("p"), F.col("question")).alias("prompt"), F.col("answer").alias("gold"), F.lit("em").alias("metric"), F.col("id").alias("raw_id"), "level", "type", F.lit(policy).alias("context_policy"), F.size("p").alias("n_context_paragraphs")))


def mmlu_rows(raw: DataFrame, role: str, split: str) -> DataFrame:
    """raw: row_index, subject, question, choices, answer. The first of rows with equal ids stays; auxiliary_train is refused."""
    if split == "auxiliary_train":
        raise ValueError("auxiliary_train is not a split of the benchmark")
    rows = corpus_rows(raw.select(F.lit("mmlu").alias("source"), F.col("subject").alias("config"), F.lit(split).alias("hf_split"), F.lit(role).alias("role"), F.lit("knowledge_mc").alias("task_type"), T.mc_prompt(F.col("question"), F.col("choices")).alias("prompt"), letter_gold(F.col("answer").cast("string")).alias("gold"), F.lit("accuracy").alias("metric"), F.col("row_index").alias("raw_id"), "row_index", "subject"))
    return first_of(rows, ["query_id"], F.col("row_index"))


BUILDERS: dict[str, Callable[..., DataFrame]] = {"arc_challenge": arc_rows, "hotpotqa": hotpot_rows, "mmlu": mmlu_rows}


def builders(enabled: dict[str, bool]) -> dict[str, Callable[..., DataFrame]]:
    """Enabled builders (all by default); an unknown name is an error."""
    unknown = set(enabled) - set(BUILDERS)
    if unknown:
        raise ValueError(f"unknown datasets: {sorted(unknown)}")
    return {k: f for k, f in BUILDERS.items() if enabled.get(k, True)}


def first_of(rows: DataFrame, keys: list[str], ordinal: Column) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal))).where("__rn = 1").drop("__rn")


def last_of(rows: DataFrame, keys: list[str], ordinal: Column) -> DataFrame:
    return first_of(rows, keys, ordinal.desc())


def random_key(seed: int, *cols: Column) -> Column:
    """Deterministic shuffle key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def sample(rows: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """k rows without replacement, by hash order."""
    return rows.withColumn("__k", random_key(seed, F.col(key))).orderBy("__k", key).limit(k).drop("__k")


def stratified_sample(rows: DataFrame, k: int, seed: int, key: str, stratum: str) -> DataFrame:
    """k rows drawn from the strata in turn: the first of each, the second of each, and so on."""
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(random_key(seed, F.col(key)), key))
    # No stratum gives more than k: Spark keeps the first k of each in every task before it shuffles them.
    return rows.withColumn("turn", turn).where(F.col("turn") <= k).orderBy("turn", stratum).limit(k)


def disjoint_splits(rows: DataFrame, sizes: dict[str, int], seed: int, key: str) -> DataFrame:
    """Consecutive slices of one shuffle, so splits cannot overlap: adds `role`."""
    total = sum(sizes.values())
    drawn = rows.withColumn("__k", random_key(seed, F.col(key))).orderBy("__k", key).limit(total)
    numbered = drawn.withColumn("__rn", F.row_number().over(Window.orderBy("__k", key)))
    role, upto = None, 0
    for name, n in sizes.items():
        upto += n
        role = F.when(F.col("__rn") <= upto, name) if role is None else role.when(F.col("__rn") <= upto, name)
    return numbered.withColumn("role", role).drop("__k", "__rn")


def head_per_role(rows: DataFrame, n: int, ordinal: str, role: str = "role") -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(role).orderBy(ordinal))).where(F.col("__rn") <= n).drop("__rn")


def smoke(config: dict, cap: int = 8) -> dict:
    """A config with every number of examples capped, two subjects at most, and a version and folder of its own."""

    def small(spec: dict) -> dict:
        roles = {r: v | {k: min(v.get(k) or cap, cap) for k in ("max_examples", "per_subject") if k in v} for r, v in spec.get("roles", {}).items()}
        return spec | {"roles": roles} | ({"subjects": spec["subjects"][:2]} if spec.get("subjects") else {})

    version = f"{config.get('version', 'corpus')}_smoke"
    return config | {"datasets": {n: small(spec) for n, spec in config.get("datasets", {}).items()}, "version": version, "output_dir": f"{config.get('output_dir', 'corpus')}_smoke"}


def _drawn(raw: DataFrame, spec: dict, seed: int) -> DataFrame:
    """The rows of one role: all, or a sample; by subject where the spec says so."""
    key = "id" if "id" in raw.columns else "row_index"
    if spec.get("per_subject"):
        turn = F.row_number().over(Window.partitionBy("subject").orderBy(random_key(seed, F.col("subject"), F.col(key)), key))
        return raw.withColumn("__turn", turn).where(F.col("__turn") <= spec["per_subject"]).drop("__turn")
    if not spec.get("max_examples"):
        return raw
    if "type" in raw.columns and "level" in raw.columns:
        strata = raw.withColumn("__stratum", F.concat_ws("|", "type", "level"))
        return stratified_sample(strata, spec["max_examples"], seed, key, "__stratum").drop("__stratum", "turn")
    return sample(raw, spec["max_examples"], seed, key)


def built(config: dict, staged: Callable[[str, str], DataFrame]) -> DataFrame:
    """The corpus of a config: rows of all enabled datasets and roles, in one table.

    staged(dataset, split) gives the raw rows of a split. Roles that share a split get disjoint slices of one shuffle.
    """
    specs, seed, out = config["datasets"], int(config.get("seed", 42)), None
    for name, build in builders({n: spec.get("enabled", True) for n, spec in specs.items()}).items():
        if name not in specs:
            continue
        spec = specs[name]
        extra = {"policy": spec["context_policy"]} if "context_policy" in spec else {}
        by_split: dict[str, list[str]] = {}
        for role, r in spec["roles"].items():
            by_split.setdefault(r["split"], []).append(role)
        for split, roles in by_split.items():
            raw = staged(name, split)
            if spec.get("subjects"):
                raw = raw.where(F.col("subject").isin(*spec["subjects"]))
            if len(roles) > 1:
                cut = disjoint_splits(raw, {r: spec["roles"][r]["max_examples"] for r in roles}, seed, "id")
            for role in roles:
                own = _drawn(raw, spec["roles"][role], seed) if len(roles) == 1 else cut.where(F.col("role") == role).drop("role")
                rows = build(own, role, split, **extra)
                out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no dataset is enabled")
    return out


def violations(rows: DataFrame, forbidden: tuple[str, ...] = ("auxiliary_train",)) -> DataFrame:
    """(check, detail, n): rules the corpus breaks; an empty result is a sound corpus."""
    ids = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.collect_set("role").alias("roles"))
    empty = rows.agg(F.count("*").alias("c")).where("c = 0").select(F.lit("no_rows").alias("check"), F.lit("").alias("detail"), F.lit(1).cast("long").alias("n"))
    duplicate = ids.where("n > 1").select(F.lit("duplicate_id").alias("check"), F.col("query_id").alias("detail"), "n")
    split = rows.where(F.col("hf_split").isin(*forbidden)).groupBy("hf_split").agg(F.count("*").alias("n")).select(F.lit("forbidden_split").alias("check"), F.col("hf_split").alias("detail"), "n")
    blank = rows.where("prompt = '' or gold = '' or prompt is null or gold is null").groupBy("source").agg(F.count("*").alias("n")).select(F.lit("empty_text").alias("check"), F.col("source").alias("detail"), "n")
    overlap = ids.where("size(roles) > 1").select(F.lit("role_overlap").alias("check"), F.col("query_id").alias("detail"), F.size("roles").cast("long").alias("n"))
    return empty.unionByName(duplicate).unionByName(split).unionByName(blank).unionByName(overlap).unionByName(text_leakage(rows).select(F.lit("text_leakage").alias("check"), F.col("text_hash").alias("detail"), F.col("n_roles").alias("n")))


def text_leakage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("text_hash").agg(F.countDistinct("role").alias("n_roles")).where("n_roles > 1")


def assert_sound(rows: DataFrame) -> None:
    broken = violations(rows).orderBy("check", "detail").limit(20).collect()
    if broken:
        raise ValueError("; ".join(f"{r['check']}: {r['detail']} ({r['n']})" for r in broken))


def fingerprints(rows: DataFrame) -> DataFrame:
    """Per role: rows, distinct ids and a hash of its sorted ids."""
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("query_id")), "\n"), 256).alias("fingerprint"))
