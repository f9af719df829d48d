"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extract, jaccard_join, language_id, media, packing, pii, suffix_dedup, token_binary, toxicity
from .common import fold, table


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.token_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents")).drop("set_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit_on(docs)
    return language_id.predict(docs.select("doc_id", "text"), net).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_documents(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    counts = [F.size(pii.of_kind("pii", k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("pii")).alias("spans"), F.transform("pii", lambda s: F.round(s["score"], 6)).alias("scores"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digested(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near"), F.sha2(F.array_join("near_items", ","), 256).alias("near_sha256"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_docs(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity.score").alias("score"), (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"), F.col("toxicity.evidence").alias("evidence"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0)


def queries() -> dict:
    own = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(own.items(), key=lambda x: int(x[0][2:].split("_")[0])))


#: Words as the operator takes them.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = r"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(ws[p : p + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM docs WHERE len(ws) > 0)),
sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM sets GROUP BY r),
shared AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM sets x JOIN sets y USING (g) WHERE x.r < y.r GROUP BY x.r, y.r),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS r, a AS other FROM both_ways UNION SELECT reach.r, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other),
least AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN docs d ON d.r = reach.other GROUP BY reach.r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM docs LEFT JOIN sizes USING (r) LEFT JOIN least USING (r)
"""

#: Two hex digits a byte; pieces of 1000 starts keep substr cheap.
OP6_SQL = """
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT r, 1000 * k AS base, substr(h, 2000 * k + 1, 2398) AS p FROM (SELECT r, h, unnest(range(0, len(h) // 2000 + 1)) AS k FROM docs)),
strings AS MATERIALIZED (
  SELECT r, base + j AS i, hash(substr(p, 2 * j + 1, 400)) AS g FROM (SELECT r, base, p, unnest(range(0, 1000)) AS j FROM pieces) WHERE 2 * j + 400 <= len(p)),
repeats AS (SELECT r, i FROM strings WHERE g IN (SELECT g FROM strings GROUP BY g HAVING count(*) > 1)),
begun AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM repeats),
runs AS (SELECT r, min(i) AS s, max(i) + 200 AS e FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM begun) GROUP BY r, k),
gaps AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS f, s AS t FROM runs UNION ALL SELECT r, max(e), NULL FROM runs GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * f + 1, 2 * (coalesce(t, len(h) // 2) - f)), '' ORDER BY f) AS x FROM gaps JOIN docs USING (r) GROUP BY r),
totals AS (SELECT r, sum(e - s) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(x, h))) AS kept_sha256
FROM docs LEFT JOIN totals USING (r) LEFT JOIN kept USING (r)
"""

OP7_SQL = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[p : p + least(len(ws), 10) - 1], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM items WHERE len(ws) > 0)),
places AS (
  SELECT r, k, p, array_to_string(ws[p : p + k - 1], ' ') AS g
  FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM docs, (SELECT DISTINCT k FROM windows))),
found AS (SELECT r, k, p, item_id FROM places JOIN windows USING (k, g)),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS place FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY r),
words AS MATERIALIZED (SELECT r, unnest(ws) AS word, unnest(range(0, len(ws))) AS p FROM docs),
counted AS (SELECT word, count(*) AS n FROM words GROUP BY word),
window_words AS (SELECT g, word, min(o) AS o FROM (SELECT g, unnest(string_split(g, ' ')) AS word, unnest(range(0, k)) AS o FROM (SELECT DISTINCT g, k FROM windows)) GROUP BY g, word),
rare AS (SELECT g, word, o, n, row_number() OVER (PARTITION BY g ORDER BY coalesce(n, 0), word, o) AS rk FROM window_words LEFT JOIN counted USING (word)),
pair AS (
  SELECT g, max(word) FILTER (rk = 1) AS t0, max(o) FILTER (rk = 1) AS o0, max(word) FILTER (rk = 2) AS t1, max(o) FILTER (rk = 2) AS o1
  FROM rare WHERE rk <= 2 GROUP BY g HAVING max(n) FILTER (rk = 1) > 0),
starts AS (SELECT r, g, p - o0 AS s, t1, o1 FROM words JOIN pair ON word = t0),
near AS (
  SELECT r, g FROM starts WHERE t1 IS NULL
  UNION SELECT starts.r, g FROM starts JOIN words ON words.r = starts.r AND words.word = t1 WHERE abs(words.p - s - o1) <= 4),
near_named AS (SELECT r, count(*) AS n_near, string_agg(i, ',' ORDER BY i) AS near_items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM near JOIN windows USING (g)) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(near_items, '')) AS near_sha256
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r) LEFT JOIN near_named USING (r)
"""


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL gives on whole tables at little cost; the others are compared with plain versions in tests."""
    return {"op2_jaccard_join": OP2_SQL, "op6_suffix_dedup": OP6_SQL, "op7_decontamination": OP7_SQL}
