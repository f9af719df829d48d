"""Benchmark decontamination by a distributed positional inverted index; DataFrame functions only.

Words: A-Z lower-cased, maximal runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`. A window is `window` consecutive words of
a benchmark item; an item with fewer words, but at least one, is one window.

1. The corpus frequency of every benchmark word is counted over all documents.
2. For each distinct window its `rarest` rarest terms are chosen. Only these terms get postings (term, document,
   position), stored for all documents.
3. Postings are shifted by the term's offset in the window. Starts that the rarest term names and the other chosen
   terms confirm within `slop` positions are near places; those confirmed exactly are candidates.
4. Candidate starts are compared with the whole window in the document's words: exact phrase matches.
   Proximity matches are the (document, item) pairs with a near place.

Defined results: null or wordless text has no words and no hits; null items count for nothing; items with equal
windows each count; repeated rows get equal results each; empty tables give empty results or no hits; a null doc_id
is an id like others; other columns of docs are passed through, those that have the name of a result are replaced;
other columns of the benchmark are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, few, row_key, saved

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
RAREST = 2
SLOP = 4
RESULTS = ("n_words", "n_hit", "items", "contaminated", "near_items")


def words_of(text: Column) -> Column:
    """Array of words; null text gives none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPLIT, -1), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct windows: window_id, terms, n_terms, items (ids of the items that have it)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).where("item is not null and size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    each = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, F.lit(window)))).alias("terms"))
    return each.groupBy("terms").agg(F.collect_set("item").alias("items")).select(F.xxhash64(F.concat_ws(" ", "terms")).alias("window_id"), "terms", F.size("terms").alias("n_terms"), "items")


def keyed_words(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(*row_key(doc_id, text), words_of(F.col(text)).alias("w"))


def postings(docs: DataFrame, doc_id: str, text: str, terms: DataFrame) -> DataFrame:
    """Positional postings (term, key_id, key_text, pos) of the given terms(term) over all documents."""
    each = keyed_words(docs, doc_id, text).select("key_id", "key_text", F.posexplode("w").alias("pos", "term"))
    return each.join(terms, "term")


def chosen_terms(docs: DataFrame, doc_id: str, text: str, windows: DataFrame, rarest: int) -> DataFrame:
    """(window_id, n_chosen, rank, offset, term): each window's rarest terms by frequency over all documents; ties by term, then offset."""
    at = windows.select("window_id", F.posexplode("terms").alias("offset", "term"))
    vocabulary = saved(at.select("term").distinct(), "benchmark-terms")
    each = docs.select(F.explode(words_of(F.col(text))).alias("term")).join(vocabulary, "term")
    counts = each.groupBy("term").agg(F.count("*").alias("n"))
    # One row a distinct term and window, the first offset.
    firsts = at.groupBy("window_id", "term").agg(F.min("offset").alias("offset")).join(counts, "term", "left")
    ranked = firsts.groupBy("window_id").agg(F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset"))), 1, rarest).alias("c"))
    # A term that no document has makes the window impossible.
    possible = ranked.where(F.col("c")[0]["n"] > 0)
    return possible.select("window_id", F.size("c").alias("n_chosen"), F.posexplode("c").alias("rank", "c")).select("window_id", "n_chosen", "rank", F.col("c.offset").alias("offset"), F.col("c.term").alias("term"))


def near_starts(chosen: DataFrame, post: DataFrame, rarest: int, slop: int) -> DataFrame:
    """(key_id, key_text, window_id, start, exact): starts by the rarest term with every other chosen term within slop positions of its place; exact: all at their place, once a start.

    The list of the rarest term comes first; each further term's postings are looked up only at the places left, in
    cells of positions that are as wide as the places around one may lie.
    """
    of = lambda r: chosen.where(F.col("rank") == r).select("window_id", F.col("term").alias(f"t{r}"), F.col("offset").alias(f"o{r}"))
    cell = lambda at: F.floor(at / (2 * slop + 1))
    left = post.join(of(0), F.col("term") == F.col("t0")).select("key_id", "key_text", "window_id", (F.col("pos") - F.col("o0")).alias("start")).withColumn("exact", F.col("start") >= 0)
    for r in range(1, rarest):
        asked = left.join(of(r), "window_id", "left")
        held = post.select("key_id", "key_text", F.col("term").alias(f"t{r}"), F.col("pos").alias("at"), cell(F.col("pos")).alias("cell"))
        single = asked.where(F.col(f"t{r}").isNull()).select(*left.columns)
        place = F.col("start") + F.col(f"o{r}")
        places = asked.where(F.col(f"t{r}").isNotNull()).withColumn("place", place).withColumn("cell", F.explode(F.array_distinct(F.array(cell(place - slop), cell(place + slop)))))
        met = places.join(held, ["key_id", "key_text", f"t{r}", "cell"]).where(F.abs(F.col("at") - F.col("place")) <= slop)
        left = met.withColumn("exact", F.col("exact") & (F.col("at") == F.col("place"))).select(*left.columns).unionByName(single)
    return left


def window_places(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, window: int, rarest: int, slop: int) -> tuple[DataFrame, DataFrame]:
    """The benchmark's windows and their near places in docs."""
    windows = saved(benchmark_windows(benchmark, item_id, item_text, window), "windows")
    chosen = saved(chosen_terms(docs, doc_id, text, windows, rarest), "chosen")
    post = saved(postings(docs, doc_id, text, saved(chosen.select("term").distinct(), "rare-terms")).distinct(), "postings")
    return windows, near_starts(chosen, post, rarest, slop)


def phrase_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """Exact phrase matches by document: key_id, key_text, n_hit (words inside a match), items (sorted ids), hits (start, length, items)."""
    windows, places = window_places(docs, benchmark, doc_id, text, item_id, item_text, window, rarest, 0)
    return phrases_at(docs, windows, places, doc_id, text)


def phrases_at(docs: DataFrame, windows: DataFrame, places: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The phrase matches among the exact places."""
    found = places.where("exact").join(windows, "window_id")
    by_doc = saved(found.groupBy("key_id", "key_text").agg(F.collect_list(F.struct("start", "n_terms", "terms", "items")).alias("cands")), "candidates")
    candidate_docs = docs.select(doc_id, text).withColumns(dict(zip(("key_id", "key_text"), row_key(doc_id, text), strict=True)))
    # The texts of other documents do not travel.
    own = candidate_docs.join(few(by_doc.select("key_id", "key_text")), ["key_id", "key_text"], "left_semi")
    whole = own.join(by_doc, ["key_id", "key_text"])
    # The words are bound as a variable and the hits are written: neither is made anew for each use.
    held = F.transform(F.array(words_of(F.col(text))), lambda w: F.filter("cands", lambda c: F.slice(w, c["start"] + 1, c["n_terms"]) == c["terms"]))[0]
    hits = saved(whole.select("key_id", "key_text", held.alias("h")), "hits").where("size(h) > 0")
    positions = F.array_distinct(F.flatten(F.transform("h", lambda c: F.sequence(c["start"], c["start"] + c["n_terms"] - 1))))
    found = hits.select(
        "key_id", "key_text", F.size(positions).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.col("h.items")))).alias("items"),
        F.transform("h", lambda c: F.struct(c["start"].alias("start"), c["n_terms"].alias("length"), c["items"].alias("items"))).alias("hits"),
    )
    return found.dropDuplicates(["key_id", "key_text"])  # repeated rows have equal matches


def proximity_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, rarest: int = RAREST, slop: int = SLOP) -> DataFrame:
    """(doc_id, key_text, item, n_windows): windows whose chosen terms all stand within slop positions of the place their rarest term gives the phrase, by id and hash of the text."""
    windows, places = window_places(docs, benchmark, doc_id, text, item_id, item_text, window, rarest, slop)
    each = places.join(windows.select("window_id", F.explode("items").alias("item")), "window_id").groupBy("key_id", "key_text", "item").agg(F.countDistinct("window_id").alias("n_windows"))
    return each.select(F.when(F.col("key_id") != -(2**63), F.col("key_id")).alias(doc_id), "key_text", "item", "n_windows")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, rarest: int = RAREST, slop: int = SLOP) -> DataFrame:
    """All rows of docs with n_words, n_hit, items (sorted ids as strings), contaminated and near_items (items with a proximity match, sorted) beside their own columns."""
    windows, places = window_places(docs, benchmark, doc_id, text, item_id, item_text, window, rarest, slop)
    places = saved(places, "places")
    phrases = phrases_at(docs, windows, places, doc_id, text).select("key_id", "key_text", "n_hit", "items")
    near = places.select("key_id", "key_text", "window_id").distinct().join(windows.select("window_id", F.explode("items").alias("item")), "window_id").groupBy("key_id", "key_text").agg(F.array_sort(F.collect_set("item")).alias("near"))
    matches = saved(near.join(phrases, ["key_id", "key_text"], "left"), "matches")  # a phrase match is a proximity match
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    own = docs.select(*docs.columns, *[c.alias(f"__{n}") for n, c in zip(("key_id", "key_text"), row_key(doc_id, text), strict=True)])
    found = matches.select(F.col("key_id").alias("__key_id"), F.col("key_text").alias("__key_text"), F.col("n_hit").alias("__n_hit"), F.col("items").alias("__items"), F.col("near").alias("__near"))
    joined = own.withColumn("__n_words", F.size(words_of(F.col(text))).cast("long")).join(found, ["__key_id", "__key_text"], "left")
    return joined.select(*kept, F.col("__n_words").alias("n_words"), F.coalesce("__n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("__items", F.array().cast("array<string>")).alias("items"), (F.coalesce("__n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("__near", F.array().cast("array<string>")).alias("near_items"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """The rows of docs without a match."""
    hit = saved(phrase_matches(docs, benchmark, doc_id, text, item_id, item_text, window, rarest).select(F.col("key_id").alias("__key_id"), F.col("key_text").alias("__key_text")), "hit")
    return docs.withColumns(dict(zip(("__key_id", "__key_text"), row_key(doc_id, text), strict=True))).join(few(hit), ["__key_id", "__key_text"], "left_anti").select(*docs.columns)
