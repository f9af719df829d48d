import hashlib
import random
import time
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from escalade.llm import common, decontamination, html_extract, jaccard_join, language_id, media, packing, pii, queries, suffix_dedup, token_binary, toxicity

from . import brute

SCHEMA = "doc_id long, text string, key_id string, w int"
LONG = " ".join(f"w{i}" for i in range(40000))


def hard():
    """Nulls, empty and very long texts, ties, repeated rows, near copies."""
    rng = random.Random(4)
    base = " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randint(0, 99)) for _ in range(120))
    near = base.replace(" ", " x ", 1)
    rows = [(1, None), (2, ""), (3, " \n "), (4, base), (5, base), (6, near), (7, LONG), (8, LONG + " end"), (9, "one two"), (10, "two one"), (11, "one two"), (12, "a" * 5000), (13, "mail me: joe@example.com, 4111 1111 1111 1111 or +49 (30) 1234567 at 10.0.0.1"), (14, "Ä" * 300)]
    return rows + [(4, base)] + [(20 + i, base + f" tail{i}") for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "clash", 1) for d, t in hard()], SCHEMA).repartition(5)


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_jaccard(docs):
    assert rows_of(jaccard_join.jaccard_classes(docs), "doc_id", "n_shingles", "component_id") == sorted(brute.op2(hard()))


def test_jaccard_of_a_group_of_uneven_copies(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        words = [f"w{k}" for k in range(60)]
        for at in rng.choice(60, int(rng.integers(0, 5)), replace=False):
            words[at] = f"x{rng.integers(0, 9)}"
        rows.append((i, " ".join(words)))
    assert rows_of(jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id") == sorted(brute.op2(rows))


def test_sketches_bound_differences():
    rng = np.random.default_rng(6)
    for n, gone in ((3, 1), (40, 9), (300, 60), (5000, 1200)):
        s = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        t = np.union1d(s[gone:], rng.integers(0, 2**63, 2, dtype=np.uint64))
        assert jaccard_join.least_difference(jaccard_join.sketch(s), jaccard_join.sketch(t)) <= len(np.setxor1d(s, t))


def test_one_of_each_class(docs):
    kept = jaccard_join.one_of_each_class(docs)
    assert kept.columns == docs.columns
    want = {c for _, n, c in brute.op2(hard()) if n}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([*want, 1, 2, 3])


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(1)
    for size in [*range(1, 40), 100, 333, 1000]:
        for _ in range(20):
            s = np.unique(rng.integers(1, 2**63, size, dtype=np.uint64))
            most = len(s) // 4
            drop = rng.permutation(len(s))[: rng.integers(0, most + 1)]
            t = np.delete(s, drop)
            room = int((len(t) / 0.75) - len(s))
            if room > 0:
                s = np.unique(np.concatenate([s, rng.integers(1, 2**63, rng.integers(0, room + 1), dtype=np.uint64)]))
            both = len(np.intersect1d(s, t))
            if 100 * both < 75 * (len(s) + len(t) - both):
                continue
            sig, who = jaccard_join.signatures([s, t])
            assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())


def test_suffix(docs):
    got = suffix_dedup.digested(suffix_dedup.remove_repeats(docs))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op6([(d, t if d not in (7, 8) else t) for d, t in hard()]))


def test_suffix_of_a_bucket_of_many_contexts(spark):
    # One passage of 230 bytes in 300 documents that differ around it, in some of them shortened on either side.
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = word(230)
    rows = [(i, word(150) + passage[rng.choice((0, 0, 20, 60)) : rng.choice((230, 230, 215, 150))] + word(150)) for i in range(300)]
    rows += [(400, passage + passage), (401, rows[0][1]), (402, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.digested(suffix_dedup.remove_repeats(df))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op6(rows))


def test_minima():
    rng = np.random.default_rng(2)
    for n, w, top in [(50, 7, 5), (7, 7, 3), (200, 13, 2), (6, 7, 9)]:
        h = rng.integers(0, top, n).astype(np.uint64)
        want = [i + int(np.argmin(h[i : i + w])) for i in range(n - w + 1)]
        assert suffix_dedup.window_minima(h, w).tolist() == want


def test_pii(spark, docs):
    tricky = [(100, "a@b.co_x@d.ee a@b a@b..c x%y@z-z.a.b 1.2.3.4.5 256.1.1.1 000255.0.0.1"), (101, "4111-1111-1111-1111 4111 1111 1111 1112 +1 (555) 123-4567 +12"), (102, "é 🙂 joe@x.org IBAN DE89 3704 0044 0532 0130 00 ssn 123-45-6789"), (103, "9" * 3000 + "." + "a." * 3000)]
    rows = hard() + tricky
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_pii(df)
    assert found.columns == ["doc_id", "text", "pii"]
    got = []
    for r in found.collect():
        base = [s for s in r["pii"] if s["kind"] in pii.BASE]
        spans = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in base)
        got.append((r["doc_id"], *[sum(s["kind"] == k for s in base) for k in pii.BASE], hashlib.sha256(spans.encode()).hexdigest()))
        if r["doc_id"] == 102:
            assert {s["kind"] for s in r["pii"]} == {"email", "iban", "ssn", "card"} - ({"card"} if not any(s["kind"] == "card" for s in r["pii"]) else set())
    assert sorted(got) == sorted(brute.op5(rows))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert "joe@" not in clean[13] and "[EMAIL]" in clean[13] and clean[1] is None and clean[9] == "one two"


def test_decontamination(spark, docs):
    base = dict(hard())[4]
    items = [(1, " ".join(base.split()[30:45])), (2, "Two, ONE!"), (3, None), (4, ""), (5, "not in any text at all here"), (6, "two one"), (7, " ".join(LONG.split()[39000:39030]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.decontaminate(docs, bench)
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), brute.sha(",".join(r["items"])), r["contaminated"]) for r in out.collect())
    assert got == sorted(brute.op7(hard(), items))
    near = decontamination.proximity_matches(docs, bench)
    assert (4, "1") in {(r["doc_id"], r["item"]) for r in near.collect()}
    assert decontamination.without_contaminated(docs, bench).columns == docs.columns


def test_proximity(spark):
    words = [f"q{i}" for i in range(10)]
    phrase, moved = " ".join(words), " ".join([*words[:5], "x", "y", *words[5:]])
    far = " ".join([*words[:1], *["z"] * 9, *words[1:]])
    rows = [(1, phrase), (2, moved), (2, "other"), (None, moved), (3, far), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, phrase)], "item_id long, text string")
    got = {(r["doc_id"], r["text"]): (r["n_hit"], r["near_items"]) for r in decontamination.decontaminate(docs, bench, rarest=10).collect()}
    assert got == {(1, phrase): (10, ["7"]), (2, moved): (0, ["7"]), (2, "other"): (0, []), (None, moved): (0, ["7"]), (3, far): (0, []), (4, None): (0, [])}
    near = decontamination.proximity_matches(docs, bench).collect()
    assert {r["doc_id"] for r in near} >= {1, 2, None} and len({(r["doc_id"], r["key_text"]) for r in near}) == len(near)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got, *columns) == sorted(want.fetchall())


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = brute.tokenizer("word_bpe_49k.json")
    out = packing.pack_documents(docs, path).toPandas()
    want = []
    for d, text in hard():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(d, k, a, len(ids[a : a + 2048]), brute.crc(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(want)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 2048 and (g["length"].cumsum() - g["length"]).tolist() == g["offset"].tolist()


def test_best_fit_rounds():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(1, 65, 300)
        counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
        rounds, n = packing.best_fit_rounds(counts, 64)
        gaps: list[int] = []  # plain best fit, longest first
        for x in sorted(lengths.tolist(), reverse=True):
            fits = [g for g in gaps if g >= x]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - x)
            else:
                gaps.append(64 - x)
        assert n == len(gaps) and sum(r[2] for r in rounds.tolist()) == 300


def test_token_shards(docs):
    out = token_binary.token_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert rows_of(out, "doc_id", "n_tokens", "ids_crc32") == sorted((d, n, c) for d, _, n, c in brute.op1(hard()))
    starts = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in out.collect())
    assert starts[0][0] == 0 and all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(starts, starts[1:], strict=False))


def test_grammar_round_trip():
    rng = np.random.default_rng(3)
    for _ in range(10):
        ids = [np.append(rng.integers(0, 6, rng.integers(0, 3000)), 2).astype(np.uint32) for _ in range(20)]
        data = token_binary.write_shard(list(range(20)), ids, 2)
        s = token_binary.Shard(data)
        assert len(s.rules) > 0 and all((a == b).all() for a, b in zip(ids, s.all_ids(), strict=True))
        assert (s.ids(7) == ids[7]).all() and s.lengths.tolist() == [len(x) for x in ids]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_units(name):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab'sT.,! \n\t1é ́ßΣ<|>|\x00") for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["<|endoftext|> x", "it's  a", "", "日本 語"]
    enc, t = common.encoder(public_tokenizers.path(name)), brute.tokenizer(name)
    assert [x.tolist() for x in enc.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_media(spark, docs, tmp_path):
    out = media.media_documents(docs).toPandas()
    assert len(out) == len(hard())
    for d, t in hard():
        b = (t or "").encode()
        p = b + bytes(64 - len(b) % 64 if len(b) % 64 or not b else 0)
        own = out[(out.doc_id == d) & (out.n_bytes == len(b))].iloc[0]
        assert own.payload_bytes == len(p) and own.payload_sha256 == brute.sha(p)
    path = f"file://{tmp_path}/m"
    media.write_archives(docs, path)
    assert media.read_archives(spark, path, partition_bytes=2000).select("doc_id", "n_bytes").count() == len(hard())


def test_media_digests_and_second_write(spark, docs, tmp_path):
    out = media.media_documents(docs).collect()
    for r in out:
        payload = media.padded((dict(hard())[r["doc_id"]] or "").encode())
        image = media.to_png(payload)
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (media.zlib.crc32(payload[-64:]), len(image), brute.sha(image))
        samples = np.frombuffer(payload, np.uint8).astype(float)
        share = np.array([n / len(payload) for n in Counter(payload).values()])
        assert r["feature"] == f"mean={samples.mean():.4f};std={samples.std():.4f};entropy={-(share * np.log2(share)).sum():.4f};step={np.abs(np.diff(samples)).mean():.4f}"
    path = f"file://{tmp_path}/twice"
    for _ in range(2):
        media.write_archives(docs, path)
    assert media.read_archives(spark, path).count() == 2 * len(hard())


def test_ibans_have_their_country_s_length(spark):
    texts = ["DE89370400440532013000 BIC COBADEFFXXX", "IBAN DE89 3704 0044 0532 0130 00 EUR 50", "GB82WEST12345698765432.", "DE8937040044053201300", "XX89370400440532013000"]
    got = pii.find_pii(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["pii"] if s["kind"] == "iban"] for r in got.collect()}
    assert found == {0: [(0, 22)], 1: [(5, 32)], 2: [(0, 22)], 3: [], 4: []}


def test_clashing_columns_and_null_ids(spark):
    rows = [(None, "mail joe@x.org " + "word " * 12, 1, 2, "x"), (None, None, 1, 2, "x"), (None, "", 1, 2, "x"), (5, "word " * 12, 1, 2, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_words int, pii int, language string")
    d = d.withColumns({c: F.lit("old") for c in ("toxicity", "items", "component_id", "kept", "host", "rank", "lang", "source")})
    bench = spark.createDataFrame([(1, "word " * 12, 9)], "item_id long, text string, n_words int")
    marked = decontamination.decontaminate(d, bench)
    assert len(marked.columns) == len(set(marked.columns)) and sorted(r["n_words"] for r in marked.select("n_words").collect()) == [0, 0, 12, 16]
    assert decontamination.without_contaminated(d, bench).count() == 2
    path = public_tokenizers.path("word_bpe_49k.json")
    frames = [jaccard_join.jaccard_classes(d), pii.find_pii(d), suffix_dedup.remove_repeats(d), token_binary.token_documents(d, path, 2), packing.pack_documents(d, path), media.media_documents(d), language_id.predict(d, language_id.fit_on(d))]
    lab = spark.createDataFrame([(None, 1), (5, 0), (6, 1)], "doc_id long, toxic int")
    frames.append(toxicity.score_docs(d, toxicity.fit_on(d, lab)))
    for f in frames:
        assert sorted((r["doc_id"] is None for r in f.collect()), reverse=True) == [True] * 3 + [False]
    assert jaccard_join.one_of_each_class(d).count() == 4
    pages = spark.createDataFrame([(None, "http://a.b/c", "<p>x", 1)], "page_id long, url string, html string, n_chars int")
    assert [tuple(r) for r in html_extract.extract(pages).collect()] == [(None, "http://a.b/c", "x", 1)]


def test_very_long_texts(spark):
    text = " ".join(f"Wort{i % 5000}" for i in range(300_000))
    d = spark.createDataFrame([(1, text, "de"), (2, "short one", "en"), (3, text, "de")], "doc_id long, text string, lang string")
    assert [r["n_bytes"] for r in media.media_documents(d).where("doc_id <> 2").collect()] == [len(text)] * 2
    assert {r["language"]["lang"] for r in language_id.predict(d, language_id.fit_on(d)).where("doc_id <> 2").collect()} == {"de"}
    pages = spark.createDataFrame([(1, "http://a.b/c", f"<article>{text}")], "page_id long, url string, html string")
    assert html_extract.extract(pages).first()["n_chars"] == len(text)
    lab = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score_docs(d, toxicity.fit_on(d, lab, held_out=9)).where("doc_id = 3").first()["toxicity"]["score"] > 0.5


def test_member_is_read_again(tmp_path):
    class Flaky:
        def __init__(self):
            self.left = 2

        def open_input_file(self, path):
            self.left -= 1
            if self.left >= 0:
                raise OSError("lost")
            return media.pafs.LocalFileSystem().open_input_file(path)

    f = tmp_path / "x"
    f.write_bytes(b"..abc..")
    assert media.read_member(Flaky(), str(f), 2, 3, media.zlib.crc32(b"abc")) == b"abc"
    with pytest.raises(OSError, match="at 2"):
        media.read_member(Flaky(), str(f), 2, 3, 1, attempts=3)


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav><a>m</a></nav><div class="cookie-notice">c</div><div class="x">boiler plate</div>
<article><header><h1>Head&amp;line</h1></header><p>One <b>bold</b>er &nbsp; text<br>line<p>Two<aside>side</aside><form><input>f</form><ul><li>a<li>b</ul><div id="comments"><p>nice</p></div></article><footer>f</footer></body></html>"""


def test_re_pair_goes_on_until_no_pair_is_frequent():
    passage = np.random.default_rng(0).integers(0, 5000, 4000)
    ids = [np.append(np.tile(passage, 2), 9999) for _ in range(20)]
    shard = token_binary.Shard(token_binary.write_shard(list(range(20)), ids, 9999))
    assert len(shard.symbols) <= 3 * 20 and len(shard.rules) > 2048
    assert all((shard.ids(i) == ids[i]).all() for i in (0, 19))
    rng = np.random.default_rng(8)
    some = np.concatenate([np.append(rng.zipf(1.3, 400) % 50, 9999) for _ in range(60)])
    symbols, _ = token_binary.re_pair(some, 10_000, 9999)
    left = {}
    for a, b in zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True):
        if 9999 not in (a, b):
            left[a, b] = left.get((a, b), 0) + 1
    assert max(left.values()) < token_binary.MIN_COUNT


def test_unit_cache_that_overflows(monkeypatch):
    monkeypatch.setattr(common.UnitEncoder, "LIMIT", 50)
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, t = common.UnitEncoder(path), brute.tokenizer("byte_bpe_50k.json")
    rng = random.Random(3)
    for _ in range(20):
        texts = [" ".join(rng.choice(["a", "Bc,", "x1", "it's", "q\nr."]) + str(rng.randint(0, 40)) * rng.randint(0, 1) for _ in range(30)) for _ in range(5)]
        assert [x.tolist() for x in enc.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_token_shards_of_equal_ids(spark):
    rows = [(1, f"text {i % 7}") for i in range(40)] + [(None, "z"), (None, None)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    frames = [token_binary.token_documents(spark.createDataFrame(rows[::k], "doc_id long, text string"), path, 2) for k in (1, -1)]
    assert rows_of(frames[0], "start", "n_tokens", "ids_crc32") == rows_of(frames[1], "start", "n_tokens", "ids_crc32")


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 500)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(300)] + [(None, 3), (7, 7)]
    forest = common.Forest()
    for a, b in edges:
        if a is not None and a != b:
            forest.join(a, b)
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()))
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert {x: got.get(x, x) for x in nodes} == {x: forest.root(x) for x in nodes}


def test_html(spark):
    assert html_extract.main_text(PAGE) == "Head&line One bolder text line Two a b"
    assert html_extract.main_text("<p>a<div>b</span>c</p>") == "a bc" and html_extract.main_text("") == "" and html_extract.main_text("x &lt; y") == "x < y"
    assert html_extract.main_text("<div>" * 5000 + "deep") == "deep"
    body = lambda i: f"<body><div><p>same {'x' if i % 2 else 'y'} everywhere</p></div><div><p>own {i}</p></div></body>"
    rows = [(i, "http://h.org/%d" % i, body(i), "z") for i in range(20)] + [(30, None, body(1), "z"), (31, "http://h.org/x", None, "z"), (32, "http://h.org/y", "", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got[3] == "own 3" and got[30] == "same x everywhere own 1" and got[31] == "" and got[32] == ""


def test_html_keeps_names_that_only_contain_a_function():
    for x in ('<div class="share-price">a</div>', '<p class="related-work">a', '<section id="search-results">a</section>', '<div class="cookie-recipe">a</div>', '<div class="notice">a</div>'):
        assert html_extract.main_text(f"<body><article>{x}</article>") == "a"
    assert html_extract.main_text('<body><div class="x Sidebar">s</div><p>a</p><div class="sidebar-free">b') == "a b"


def test_html_takes_linear_time():
    n = 100_000
    hard_pages = ["<b " * n, '<b "' * n + ">", '<b a="x>y"' * n, "<b>" * n + "<p>" * n, "<p><div>" + "<b>" * n + "<p>" * n, "<b>" * n + "</i>" * n, "<" * n + ">", "<!" * n, "<!--" * n, "<table>" + "<tr><td>" * n, "<a " + " " * n + ">", "<a b='" * n + ">", "&amp" * n]
    for p in hard_pages:
        start = time.process_time()
        html_extract.hashed(html_extract.parse(p))
        assert time.process_time() - start < 8, p[:20]
    assert html_extract.main_text("<b " * n).startswith("<b <b")


def test_html_equals_a_plain_parser(spark):
    d = "/root/testdata/sf0.01"
    html = {(r["page_id"], r["url"]): r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = queries.op8_html_text(spark, d).collect()
    assert len(got) == len(html) and all(r["text"] == brute.op8(html[r["page_id"], r["url"]]) and r["n_chars"] == len(r["text"]) for r in got)


def test_html_copies_are_no_template(spark):
    article = "<body><article><h1>Head</h1><p>all of the text</p></article><p>foot {}</p></body>"
    plain = "<body><div><p>shared line</p></div><div><p>{}</p></div></body>"
    rows = [(i, "http://a.org/x", article.format(i)) for i in range(6)]
    rows += [(100 + i, "http://b.org/%d" % i, plain.format("the copied page" if i < 10 else f"own {i}")) for i in range(30)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(6)} == {"Head all of the text"}
    assert {got[100 + i] for i in range(10)} == {"the copied page"} and got[120] == "own 20"


def test_html_template_of_a_large_host(spark):
    page = lambda i: f"<body><div><p>{'rare legal line' if i < 20 else f'other {i}'}</p></div><div><p>the own long text of page {i}</p></div>{'<p>the long passage that all of the near copies have</p>' if i >= 80 else ''}</body>"
    pages = spark.createDataFrame([(i, "http://a.org/%d" % i, page(i)) for i in range(100)], "page_id long, url string, html string")
    outer = {h for r in html_extract.templates(pages, many=20).collect() for h in r["outer"]}
    assert html_extract.main_text(page(3), frozenset(outer)) == "the own long text of page 3"
    assert html_extract.main_text(page(90), frozenset(outer)).endswith("near copies have")


def test_language(spark):
    net = language_id.BiGRU(["x", "y"], hidden=4)
    x = np.random.default_rng(0).integers(0, 257, (6, 3)).astype(np.uint16)
    y = np.array([0, 1, 1])
    _, grads = net.gradients(x, y)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    for k, at in [("Ef", (int(x[2, 1]), 3)), ("Ub", (1, 2)), ("Uf", (0, 9)), ("V", (3, 1)), ("c", (0,))]:
        keep = net.p[k][at]
        net.p[k][at] = keep + 1e-3
        up = net.gradients(x, y)[0]
        net.p[k][at] = keep - 1e-3
        down = net.gradients(x, y)[0]
        net.p[k][at] = keep
        assert abs((up - down) / 2e-3 - grads[k][at]) < 2e-3
    rows = [(i, ("the cat sat on a mat " if i % 2 else "der hund und das haus ") * (i % 5 + 1), "en" if i % 2 else "de", 1) for i in range(60)] + [(100, None, "en", 1), (101, "123 !", "en", 1), (102, "", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, language int")
    out = {r["doc_id"]: r["guess"] for r in language_id.predict(df, language_id.fit_on(df), out="guess").collect()}
    assert all(out[i]["lang"] == ("en" if i % 2 else "de") for i in range(60))
    assert out[100]["lang"] == out[101]["lang"] == out[102]["lang"] == "und"


def test_language_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").where("lang is not null and lang <> 'und'").collect()}
    got = [(r["lang_pred"], truth[r["doc_id"]]) for r in queries.op3_language_id(spark, d).where("held_out").collect() if r["doc_id"] in truth]
    assert sum(a == b for a, b in got) >= 0.99 * len(got)


def test_language_of_dirty_labels(spark):
    rows = [(i, f"der hund und das haus {i}", "de") for i in range(50)] + [(100 + i, f"the cat on a mat {i}", f"odd{i}") for i in range(300)]
    net = language_id.fit_on(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=40, max_langs=10)
    assert len(net.langs) == 10 and "de" in net.langs


def test_toxicity(spark):
    rng = random.Random(0)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(4)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        rows.append((i, " ".join([*rng.sample(words, 20), *(rng.sample(["vileone", "vileness", "grossly"], 2) if bad else [])]), 5))
        labels.append((i, int(bad), None))
    rows += [(1000, None, 5), (1001, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    lab = spark.createDataFrame([*labels, (5000, None, None)], "doc_id long, toxic int, quality int")
    model = toxicity.fit_on(docs, lab)
    out = {r["doc_id"]: r["toxicity"] for r in toxicity.score_docs(docs, model).collect()}
    assert all((out[i]["score"] >= 0.5) == (i % 8 == 0) for i in range(400)) and out[1000]["score"] < 0.5 and out[1001]["score"] < 0.5
    # Neighbours equal those of a dense search over all words of the examples.
    index, text_of = model.index, {r[0]: r[1] for r in rows}
    assert set(index.vocabulary) == {w for i in model.ids.tolist() for w in text_of[i].split()}

    def dense(text):
        v = np.zeros(len(index.vocabulary))
        for w in text.split():
            if w in index.vocabulary:
                v[index.vocabulary[w]] += 1
        v = np.where(v > 0, 1 + np.log(np.maximum(v, 1)), 0) * index.weight
        return v / (np.linalg.norm(v) or 1)

    matrix = np.stack([dense(text_of[i]) for i in model.ids.tolist()])
    for i in range(0, 400, 8):
        who, cosines = index.top(*index.vector(toxicity.words_of(text_of[i])), 10)
        full = np.round(matrix @ dense(text_of[i]), 12)
        assert np.allclose(cosines, np.sort(full)[::-1][:10], atol=1e-11) and np.allclose(full[who], cosines, atol=1e-11)
    assert {e["example"] for e in out[8]["evidence"]} <= set(model.ids.tolist()) and out[1000]["evidence"] == []
    none = toxicity.fit_on(docs, lab.where("toxic = 0"))
    assert none.score("vileone")[0] == 0.0


def test_toxicity_on_held_out_rows(spark):
    """Recall of at least 0.8 and at most 2 % false alarms on the held-out fold of sf0.1."""
    d = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r["predicted"] for r in queries.op9_toxicity(spark, d).where("held_out").collect()}
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r["doc_id"] in got and r["toxic"] is not None}
    bad, clean = [i for i in truth if truth[i]], [i for i in truth if not truth[i]]
    assert sum(got[i] for i in bad) >= 0.8 * len(bad) and sum(got[i] for i in clean) <= 0.02 * len(clean)


def test_toxicity_ties(spark):
    rows = [(1, "b one"), (1, "a two"), (2, "c three"), (None, "a two"), (3, "a " * 60000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    models = [toxicity.fit_on(spark.createDataFrame(rows[::k], docs.schema), lab, held_out=9) for k in (1, -1)]
    assert [sorted(m.index.vocabulary) for m in models] == [["a", "c", "three", "two"]] * 2
    out = toxicity.score_docs(docs.withColumn("toxicity", F.lit("old")), models[0]).collect()
    assert len(out) == 5 and len({r["toxicity"]["score"] for r in out if r["text"] == "a two"}) == 1


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    lab, bench = spark.createDataFrame([], "doc_id long, toxic int, quality int"), spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = public_tokenizers.path("word_bpe_49k.json")
    frames = [
        jaccard_join.jaccard_classes(d), jaccard_join.one_of_each_class(d), suffix_dedup.digested(suffix_dedup.remove_repeats(d)), pii.find_pii(d), decontamination.decontaminate(d, bench), packing.pack_documents(d, path), token_binary.token_documents(d, path, 2),
        media.media_documents(d), html_extract.extract(pages), language_id.predict(d, language_id.fit_on(d)), toxicity.score_docs(d, toxicity.fit_on(d, lab)),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, common.saved(stage(spark, kept, sf), name)
        assert kept.columns == docs.columns
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        left = sorted(r["doc_id"] for r in kept.collect())
        if name == "toxicity":
            assert left == sorted(d for d, clean in plain_toxicity(before, spark.read.parquet(f"{sf}/labels.parquet")) if clean)
        if name == "near_duplicates":
            assert left == sorted({c if n else d for d, n, c in brute.op2(rows)})
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert left == sorted(r[0] for r in brute.op7(rows, items) if not r[-1])
        if name == "pii":
            assert left == sorted(d for d, _ in rows)
            assert all(not sum(r[1:5]) for r in brute.op5([(r["doc_id"], r["text"]) for r in kept.collect()]))
    out = corpus_pipeline.STAGES[-1][1](spark, kept, sf).toPandas()
    t, want = brute.tokenizer("word_bpe_49k.json"), []
    for r in kept.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want += [(r["doc_id"], k, a, len(ids[a : a + 2048]), brute.crc(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(want)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 2048 and (g["length"].cumsum() - g["length"]).tolist() == g["offset"].tolist()
    assert out["sequence_id"].nunique() == -(-out["length"].sum() // 2048)  # the lower bound
    ran = corpus_pipeline.run(spark, sf).toPandas()
    order = ["doc_id", "piece"]
    columns = [*order, "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert ran.sort_values(order)[columns].reset_index(drop=True).equals(out.sort_values(order)[columns].reset_index(drop=True))
    assert set(queries.queries()) == {n for n in queries.queries() if n.startswith("op")} and len(queries.queries()) == 10


def plain_toxicity(docs, labels):
    """(doc_id, clean) by dense cosines to all examples of the stage's model."""
    model = toxicity.fit_on(docs, labels)
    text_of = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    number = {w: i for i, w in enumerate(model.index.vocabulary)}

    def dense(text):
        v = np.zeros(len(number))
        for w, n in Counter(toxicity._WORD.findall(text.lower())).items():
            if w in number:
                v[number[w]] = (1 + np.log(n)) * model.index.weight[model.index.vocabulary[w]]
        return v / (np.linalg.norm(v) or 1)

    examples = np.stack([dense(text_of[i]) for i in model.ids.tolist()])
    for r in docs.collect():
        cosines = np.round(examples @ dense(r["text"] or ""), 12)
        order = np.lexsort((np.arange(len(cosines)), -cosines))[: toxicity.NEIGHBOURS]
        order = order[cosines[order] > 0]
        bad = model.labels[order] == 1
        w = cosines[order] ** 2 * np.where(bad, model.weights[1], model.weights[0])
        score = model.calibrated(float((w[bad].sum() + 0.0001) / (w.sum() + 0.0002))) if len(order) else model.base
        yield r["doc_id"], score < 0.5


def test_pipeline_of_odd_rows(spark, tmp_path):
    schema = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, s in schema.items():
        spark.createDataFrame([], s).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    rows = [(None, "some words that stand here alone " * 3, "en", None, 9), (None, None, None, "s", None), (3, "", "en", "s", 0), (4, "tie " * 30, "en", "s", 9), (4, "tie " * 30, "en", "s", 9), (5, "tie " * 30, "en", "s", 9), (6, "w " * 200_000, "en", "s", 9)]
    spark.createDataFrame(rows, schema["documents"]).withColumns({c: F.lit(1) for c in ("toxicity", "pii", "n_words", "sequence_id", "key_id")}).write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([(3, 0, None), (4, None, 0)], schema["labels"]).write.parquet(f"{tmp_path}/odd/labels.parquet")
    spark.createDataFrame([(1, None), (2, "not there")], schema["benchmark"]).write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert Counter((r["doc_id"] is None, r["doc_id"]) for r in out if r["piece"] == 0) == {(True, None): 2, (False, 3): 1, (False, 4): 1, (False, 6): 1}


def test_scratch_deletes_its_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    with common.Scratch(spark) as scratch:
        kept = scratch.save(spark.range(3), "a")
        for _ in range(5):
            scratch.save(spark.range(3), "b").select("id")  # nobody holds these
        gone = scratch.save(spark.range(3), "c")
        scratch.drop(gone)
        assert sorted(p.name[0] for p in tmp_path.iterdir()) == ["a", *"bbbbb"] and kept.count() == 3
    assert not list(tmp_path.iterdir())
