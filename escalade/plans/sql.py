"""DuckDB SQL of the registered queries, written apart from them."""

from __future__ import annotations

from ..functions import lexicon as L

WS = r"\s\x0b\x85\x1c-\x1f\p{Z}"


def q(values: list[str]) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def words(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_'']*'), lambda w: lower(w))"


def text_hash(x: str) -> str:
    return f"substr(sha256(lower(trim(regexp_replace({x}, '[{WS}]+', ' ', 'g')))), 1, 16)"


def r6(x: str, name: str) -> str:
    return f"case when isfinite({x}) then round({x}, 6) + 0.0 end as {name}"


def role(n: str) -> str:
    return f"case when {n} % 10 < 5 then 'fit' when {n} % 10 = 5 then 'calib' else 'eval' end"


CORPUS = f"""corpus as (select *, {text_hash("prompt || '||' || gold")} as text_hash from (
  select substr(sha256(concat_ws('|', d.source, d.lang, 'all', d.doc_id::varchar)), 1, 24) as query_id, d.doc_id, d.source, d.lang as config, 'all' as hf_split, {role("d.doc_id")} as role,
    {trim("d.text")} as prompt, case l.quality when 1 then 'good' when 0 then 'bad' else 'unlabelled' end as gold
  from documents d left join labels l on d.doc_id = l.doc_id))"""

MC = """mc as (select n_nationkey, 'Which region holds ' || n_name || '?' as stem, n_regionkey::varchar as key, r.texts, r.labels
  from nation, (select list(r_name order by r_regionkey) as texts, list(r_regionkey::varchar order by r_regionkey) as labels from region) r),
mcp as (select *, stem || chr(10) || chr(10) || array_to_string(list_transform(texts, lambda t, i: chr((64 + i)::int) || '. ' || t), chr(10)) || chr(10) || chr(10) || 'Answer with the option letter only.' as prompt from mc)"""

HOP = """hop as (select r_regionkey, r_name, list(n_name || ': ' || n_name || ' is a nation. Its key is ' || n_nationkey || '.' order by n_nationkey) as paras from region join nation on n_regionkey = r_regionkey group by all),
hp as (select r_regionkey, 'Question: What lies in ' || r_name || '?' || chr(10) || chr(10) || 'Answer briefly.' as question_only, array_to_string(paras, chr(10) || chr(10)) as ctx, array_to_string(paras[1:2], chr(10) || chr(10)) as ctx2, r_name from hop)"""


def hits(terms: list[str], toks: str, text: str) -> str:
    return f"len(list_filter({q(terms)}, lambda w: list_contains({toks}, w) or contains({text}, w)))"


def count_of(text: str, m: str) -> str:
    return f"((length({text}) - length(replace({text}, '{m}', ''))) // {len(m)})"


DEPTH = "greatest(" + ", ".join(
    [f"case when len(list_filter({q(L.APPLY_PHRASES)}, lambda p: contains(lower(p0), p))) > 0 then 3 else 0 end", f"case when len(list_filter({q(L.CREATE_PHRASES)}, lambda p: contains(lower(p0), p))) > 0 then 6 else 0 end"]
    + [f"case when list_has_any(toks, {q(v)}) then {L.BLOOM_LEVELS[k]} else 0 end" for k, v in L.BLOOM.items()]
) + ")"


def features(source: str, keys: str, text: str) -> str:
    """Features of free-form prompts and prompts with option lines."""
    reqs = " + ".join([f"len(regexp_extract_all(prompt, '(?:^|[{WS}])(?:\\p{{Nd}}+[\\.)]|[\\-\\*])[{WS}]+[\\p{{L}}\\p{{N}}_]'))"] + [count_of("lower(prompt)", m) for m in L.REQUIREMENT_MARKERS])
    domains = " + ".join(f"({hits(v, 'all_toks', 'lower(prompt)')} > 0)::int" for v in L.DOMAINS.values())
    w = L.MATTR_WINDOW
    stem = (
        "case when len(opts) > 0 then " + trim(f"replace(substr(prompt, 1, case when instr(prompt, chr(10) || first || '. ') > 0 then instr(prompt, chr(10) || first || '. ') - 1 when instr(prompt, first || '. ') > 0 then instr(prompt, first || '. ') - 1 else length(prompt) end), '{L.MC_INSTRUCTION}', '')")
        + f" when starts_with(prompt, 'Question:') then {trim('substr(prompt, 10)')} else prompt end"
    )
    return f"""f0 as (select {keys}, {text} as prompt from {source}),
f1 as (select *, {words("prompt")} as all_toks, regexp_extract_all(prompt, '(?m)^([A-E])\\.[{WS}]+(.*)$', 2) as opts, regexp_extract(prompt, '(?m)^([A-E])\\.[{WS}]+(.*)$', 1) as first from f0),
f2 as (select *, {stem} as p0 from f1),
f3 as (select *, {words("p0")} as toks, list_transform(opts, lambda o: len({words(trim("o"))})::double) as lens from f2),
f4 as (select {keys}, prompt, len(all_toks)::double as prompt_token_len, len(toks)::double as question_token_len, coalesce(list_avg(lens), 0.0::double) as mean_option_token_len,
  case when len(lens) > 1 then list_stddev_pop(lens) else 0.0::double end as std_option_token_len, case when list_sum(lens) > 0 then len(toks) / list_sum(lens) else len(toks)::double end as question_option_ratio,
  case when len(all_toks) = 0 then null when len(all_toks) < {w} then len(list_distinct(all_toks))::double / len(all_toks)
    else list_sum(list_transform(range(1, len(all_toks) - {w} + 2), lambda i: len(list_distinct(all_toks[i:i + {w - 1}]))))::double / {w} / (len(all_toks) - {w - 1}) end as mattr,
  ({reqs})::double as n_requirements, ({DEPTH})::double as reasoning_depth_score, {hits(L.MULTIHOP, 'toks', 'lower(p0)')}::double as multihop_score, ({domains})::double as domain_breadth, {count_of('prompt', '?')}::double as n_question_marks,
  greatest(1, len(list_filter(regexp_split_to_array(p0, '[.!?]+'), lambda s: {trim("s")} <> '')))::double as n_sentences from f3)"""


STRUCT = ["prompt_token_len", "question_token_len", "mean_option_token_len", "std_option_token_len", "question_option_ratio", "mattr"]
LING = ["n_requirements", "reasoning_depth_score", "multihop_score", "domain_breadth", "n_question_marks", "n_sentences"]
PHI = CORPUS + ", " + features("corpus", "doc_id, role", "prompt")
FLAT = PHI + ", flat as (" + " union all ".join(f"select doc_id, role, '{b}.{f}' as feature, {f} as value from f4 where {f} is not null and isfinite({f})" for b, fs in (("structural", STRUCT), ("linguistic_cues", LING)) for f in fs) + ")"
ZSTATS = FLAT + ", zs as (select feature, avg(value) as mean, case when stddev_pop(value) > 0 then stddev_pop(value) else 1.0::double end as std from flat where role = 'fit' group by feature)"

V = "vecs as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings)"
CENTER = V + ", cent as (select list(m order by i) as c from (select i, avg(v[i]) as m from vecs, range(1, 65) t(i) where vec_id % 5 < 3 group by i))"
DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i] * {b}[i]))"
KNN = V + f""", nv as (select vec_id, list_transform(v, lambda x: x / sqrt({DOT.format(a="v", b="v")})) as v from vecs),
dist as (select a.vec_id, b.vec_id as o, 1 - list_dot_product(a.v, b.v) as d from nv a, nv b where b.vec_id % 5 < 3),
near as (select * from (select *, row_number() over (partition by vec_id order by round(d, 12), o) as rk from dist) where rk <= 10)"""
LOF = KNN + """, own as (select * from (select *, row_number() over (partition by vec_id order by round(d, 12), o) as rk from dist where vec_id % 5 < 3 and o <> vec_id) where rk <= 10),
kd as (select vec_id, max(d) as kd from own group by vec_id),
fl as (select own.vec_id, 1 / (avg(greatest(kd, d)) + 1e-10) as lrd from own join kd on kd.vec_id = own.o group by own.vec_id),
ql as (select near.vec_id, 1 / (avg(greatest(kd, d)) + 1e-10) as lrd, avg(fl.lrd) as around from near join kd on kd.vec_id = near.o join fl on fl.vec_id = near.o group by near.vec_id),
lof as (select vec_id, around / lrd as lof from ql), st as (select avg(lof) as m, stddev_pop(lof) as s from lof where vec_id % 5 < 3)"""

BASE = V + f""", b0 as (select *, label % 3 as kind, [v[1], v[2], v[3], v[4]] as wl, [v[5] + 0.5 * v[9], v[6] + 0.5 * v[10], v[7] + 0.5 * v[11], v[8] + 0.5 * v[12]] as sl from vecs),
b1 as (select *, list_transform(range(1, 5), lambda i: 0.6::double * wl[i] + sl[i]) as gl from b0),
base as (select vec_id, substr(sha256('emb|' || vec_id::varchar), 1, 24) as query_id, 'src' || kind as source, {role("vec_id")} as role, kind <> 2 as is_mc, ['A', 'B', 'C', 'D'][list_position(gl, list_max(gl))] as gold, wl, sl,
  v[13] as C_length, case when vec_id % 31 <> 0 then v[14] end as C_density, v[15] as C_atypical, v[16] as C_linguistic, (v[13] + coalesce(case when vec_id % 31 <> 0 then v[14] end, 0) + v[15] + v[16]) / 4 as C_query,
  case when vec_id % 97 <> 6 then 100.0::double + vec_id % 17 end as latency_weak, case when vec_id % 89 <> 8 then 900.0::double + vec_id % 101 end as latency_strong, vec_id % 50 <> 4 as has_strong from b1)"""


def dist_scores(name: str, logits: str, where: str = "true") -> str:
    return f"""{name}0 as (select *, list_transform({logits}, lambda x: exp(8 * x)) as e from base where {where}),
{name}1 as (select *, list_reverse_sort(list_transform(range(1, 5), lambda i: {{'p': e[i] / list_sum(e), 'l': ['A', 'B', 'C', 'D'][i]}})) as d from {name}0),
{name}2 as (select *, -list_sum(list_transform(d, lambda x: x.p * ln(x.p))) as H, d[1].p as p_max, d[1].l as pred, d[1].p - d[2].p as margin, d[1].p + d[2].p as top2_mass, 4 as n_options from {name}1),
{name} as (select *, exp(H) as perplexity_H, 1 / p_max as inv_p_max, -ln(p_max) as surprisal from {name}2)"""


PROBES = BASE + ", " + dist_scores("weak", "wl") + ", " + dist_scores("strong", "sl", "has_strong")
JOINED = PROBES + """, joined as (select w.* exclude (latency_strong), w.pred as weak_pred, s.pred as strong_pred, case when w.has_strong then w.latency_strong end as latency_strong, w.pred = w.gold as weak_ok, s.pred = s.gold as strong_ok,
  w.pred <> w.gold as weak_wrong, w.pred <> w.gold and coalesce(s.pred = s.gold, false) as needs_strong, w.pred <> w.gold and w.has_strong and not coalesce(s.pred = s.gold, false) as both_wrong
  from weak w left join strong s on w.vec_id = s.vec_id)"""
FEATS = [*L.PHI, *L.PSI]


def sliced(rel: str, name: str) -> str:
    return f"""{name} as (select *, 'pooled' as slice from {rel} union all select *, 'mc_pooled' from {rel} where is_mc and (select count(*) filter (is_mc) from {rel}) < (select count(*) from {rel}) union all select *, source from {rel})"""


def auroc(rel: str, groups: str, y: str, s: str) -> str:
    """(groups, n, n_pos, auroc) of finite scores."""
    part = f"partition by {groups}" if groups else ""
    g = f"{groups}," if groups else ""
    same = f"partition by {g} s"
    by = f"group by {groups}" if groups else ""
    return f"""select {g} n, n_pos, case when n_pos > 0 and n_pos < n then (r - n_pos * (n_pos + 1) / 2.0::double) / (n_pos::double * (n - n_pos)) end as auroc from (
  select {g} count(*) as n, sum(y)::bigint as n_pos, sum(case when y = 1 then rk end) as r from (
    select {g} y, rank() over ({part} order by s) + (count(*) over ({same}) - 1) / 2.0::double as rk from (select {g} ({y})::int as y, ({s})::double as s from {rel}) where s is not null and isfinite(s)) {by})"""


def unpivoted(rel: str, keep: str, feats: list[str]) -> str:
    return " union all ".join(f"select {keep}, '{f}' as feature, {f}::double as value from {rel}" for f in feats)


DIRS = "case when feature in ('p_max', 'margin', 'top2_mass') then -1 else 1 end"
RANK = JOINED + ", fitrows as (select * from joined where role = 'fit' and has_strong), " + sliced("fitrows", "fs") + f", lg as ({unpivoted('fs', 'slice, needs_strong', FEATS)}), " + f"au as ({auroc('lg', 'slice, feature', 'needs_strong', f'value * {DIRS}')}), rk as (select *, {DIRS} as direction from au where n_pos > 0 and n_pos < n), ord as (select feature, row_number() over (order by round(auroc, 9) desc, feature) as place from rk where slice = 'pooled')"
SETS = RANK + ", sets as (" + " union all ".join(f"select '{k}' as set, '{f}' as feature" for k, fs in L.NAMED_SETS.items() for f in fs) + " union all " + " union all ".join(f"select '{k}', feature from ord where place <= {n}" for k, n in L.TOP_SETS.items()) + ")"
STATS = SETS + f", fl as ({unpivoted('joined', 'role', FEATS)}), fst as (select feature, coalesce(avg(value), 0) as mean, case when stddev_pop(value) > 1e-9 then stddev_pop(value) else 1.0::double end as std from fl where role = 'fit' group by feature)"
KEEP = "query_id, role, source, is_mc, weak_ok, strong_ok, has_strong, latency_weak, latency_strong"
SCORES = STATS + f", lo as ({unpivoted('joined', KEEP, FEATS)}), sc as (select set, {KEEP}, round(avg({DIRS} * (value - mean) / std), 9) as score from lo join fst using (feature) join sets using (feature) group by set, {KEEP})"


def curve(name: str, where: str) -> str:
    grid = ", ".join(f"{k / L.QUANTILE_STEPS}" for k in range(L.QUANTILE_STEPS + 1))
    return f"""{name}s as (select * from sc where role = '{where}'), {name}q as (select set, quantile_cont(score, [{grid}]) as qs from {name}s where score is not null group by set),
{name}t as (select set, 0 as idx, 'infinity'::double as tau from {name}q union all select set, row_number() over (partition by set order by tau) as idx, tau from (select distinct set, round(unnest(qs), 9) as tau from {name}q) union all select set, 1000, '-infinity'::double from {name}q),
{name}p as (select t.set, t.idx, t.tau, avg((coalesce(score >= tau, false) or tau = '-infinity'::double)::int::double) as alpha,
  case when max((((coalesce(score >= tau, false) or tau = '-infinity'::double)) and not has_strong)::int) = 1 then null else avg((case when coalesce(score >= tau, false) or tau = '-infinity'::double then strong_ok else weak_ok end)::int::double) end as accuracy,
  avg(weak_ok::int::double) as r_weak, avg(strong_ok::int::double) filter (has_strong) as r_strong from {name}t t join {name}s s on t.set = s.set group by all),
{name} as (select *, case when abs(r_strong - r_weak) >= 1e-12 then (accuracy - r_weak) / (r_strong - r_weak) end as pgr, case when tau = 'infinity'::double then 'always_weak' when tau = '-infinity'::double then 'always_strong' else 'threshold' end as tau_tag from {name}p)"""


CURVE = SCORES + ", " + curve("cv", "calib")


def picked(order: str, fits: str) -> str:
    return f"""cpt as (select set, min(alpha) filter (pgr >= 0.5) as cpt50, min(alpha) filter (pgr >= 0.8) as cpt80 from cv group by set),
pk as (select p.*, cpt50, cpt80 from (select set, tau, alpha, accuracy, pgr, not coalesce({fits}, false) as fallback, row_number() over (partition by set order by {order}) as rn from cv where tau_tag = 'threshold') p join cpt using (set) where rn = 1)"""


def _cpt(t: str) -> str:
    return picked(f"case when pgr >= {t} then 0 else 1 end, case when pgr >= {t} then round(alpha, 12) end, round(coalesce(pgr, -1e9), 12) desc, idx", f"pgr >= {t}")


CPT80 = CURVE + ", " + _cpt("0.8")
ALPHA_MAX = picked("case when alpha <= 0.25 + 1e-12 then 0 else 1 end, round(coalesce(pgr, -1e9), 12) desc, idx", "alpha <= 0.25 + 1e-12")
PICK = "select set, " + ", ".join(r6(c, c) for c in ("tau", "alpha", "accuracy", "pgr")) + ", fallback, " + ", ".join(r6(c, c) for c in ("cpt50", "cpt80")) + " from pk"
ESC = "coalesce(score >= tau, false)"
EVAL = CPT80 + ", es as (select s.*, tau from sc s join pk using (set) where role = 'eval'), " + "el as (select *, 'pooled' as slice from es union all select *, 'mc_pooled' from es where is_mc union all select *, source from es), " + f"""ev as (select set, slice, count(*) as n, avg({ESC}::int::double) as alpha, case when max(({ESC} and not has_strong)::int) = 1 then null else avg((case when {ESC} then strong_ok else weak_ok end)::int::double) end as accuracy,
  avg(weak_ok::int::double) as rw, avg(strong_ok::int::double) filter (has_strong) as rs, avg(latency_weak + case when {ESC} then coalesce(latency_strong, 0) else 0 end) as mean_path_latency_ms from el group by set, slice)"""
PGR = "case when abs(rs - rw) >= 1e-12 then (accuracy - rw) / (rs - rw) end"
SEED = "('0x' || substr(sha256(q || '|weak|{salt}'), 1, 8))::bigint"
def normalized(x: str) -> str:
    signs = L.PUNCTUATION.replace("'", "''")
    return f"trim(regexp_replace(array_to_string(list_filter(regexp_split_to_array(translate(lower({x}), '{signs}', ''), '[{WS}]+'), lambda w: w not in ('a', 'an', 'the')), ' '), '[{WS}]+', ' ', 'g'))"


def with_(ctes: str, body: str) -> str:
    return f"with {ctes} {body}"


def all6(cols: list[str]) -> str:
    return ", ".join(r6(c, c) for c in cols)


_COSINE = "{dot} / (sqrt({vv}) * sqrt({cc}))".format(dot=DOT.format(a="v", b="c"), vv=DOT.format(a="v", b="v"), cc=DOT.format(a="c", b="c"))
GEOMETRY = LOF + ", " + CENTER.removeprefix(V + ", ") + f""", g as (select vec_id, v[13] as t, v[14] as m, v[16] as n, 1 - {_COSINE} as cd, (lof - st.m) / st.s as ls from vecs join lof using (vec_id), cent, st),
gz as (select {", ".join(f"avg({x}) as m_{x}, stddev_pop({x}) as s_{x}" for x in ("t", "m", "n", "cd", "ls"))} from g where vec_id % 5 < 3),
gc as (select vec_id, (t - m_t) / s_t as C_length, (m - m_m) / s_m as C_density, 0.5 * (cd - m_cd) / s_cd + 0.5 * (ls - m_ls) / s_ls as C_atypical, (n - m_n) / s_n as C_linguistic from g, gz)"""
PROBE_RECORDS = f""", x as (select 'n' || n_nationkey as query_id, n_nationkey % 2 = 0 as mc, case when n_nationkey % 2 = 0 then stem else 'Where is it?' end as stem, case when n_nationkey % 2 = 0 then substr(prompt, length(stem) + 1) else chr(10) || chr(10) || 'Answer briefly.' end as rest from mcp),
y as (select *, ('0x' || substr(sha256(query_id || '|weak-8b|mc'), 1, 8))::bigint as s1, ('0x' || substr(sha256(query_id || '|weak-8b|hotpot|0'), 1, 8))::bigint as s2 from x),
e as (select query_id, i, exp((((s1 >> (5 * i)) % 97) + 1 + case when i = 0 then s1 % 11 else 0 end) / 10.0::double) as w from y, range(0, 5) t(i) where mc),
c as (select query_id, w / sum(w) over (partition by query_id) as p, ['A', 'B', 'C', 'D', 'E'][i + 1] as a, -i as pos from e
  union all select query_id, count(*) / 3.0::double, a, -min(i) from (select query_id, i, {q(L.SAMPLE_POOL)}[(s2 + 3 * i) % 5 + 1] as a from y, range(0, 3) t(i) where not mc) group by query_id, a),
r as (select c.*, row_number() over (partition by query_id order by round(p, 12) desc, case when mc then a else '' end desc, pos desc) as rk from c join x using (query_id)),
d as (select query_id, -sum(p * ln(p)) as H, max(p) filter (rk = 1) as p_max, max(a) filter (rk = 1) as pred, max(p) filter (rk = 1) - max(p) filter (rk = 2) as margin, max(p) filter (rk = 1) + max(p) filter (rk = 2) as top2_mass from r group by query_id),
w as (select query_id, mc, i, len(regexp_extract_all(case when mc then '' else 'Question: ' end || case when i = 0 then '' else {q(L.PARAPHRASE_PREFIXES)}[(('0x' || substr(sha256(query_id), i + 1, 2))::int + i) % 3 + 1] || ' ' end || stem || rest, '[^{WS}]+')) as n from x, range(0, 3) t(i)),
k as (select query_id, sum(n) + max(n) filter (i = 0) as prompt_tokens, max(case when mc then 0 else 48 end) as completion_tokens from w group by query_id)
select query_id, 'weak-8b' as model_id, 'weak' as model_role, 'nation' as source, 'fit' as role, case when mc then 'mc_letter' else 'freeform_clusters' end as probe, {all6(['H', 'p_max'])}, pred, {all6(['margin', 'top2_mass'])},
  0.0::double as U, 1.0::double as agreement, 3::bigint as k, pred as mode, 0.0::double as latency_ms, prompt_tokens::bigint as prompt_tokens, completion_tokens::bigint as completion_tokens, (prompt_tokens + completion_tokens)::bigint as total_tokens, 4::bigint as n_calls
from x join d using (query_id) join k using (query_id)"""


SQL: dict[str, str] = {
    "auroc_quality": with_(f"x as (select * from documents join labels using (doc_id)), a as ({auroc('x', '', 'quality = 0', 'round(n_chars / 100)')})", f"select n, n_pos, {r6('auroc', 'auroc')} from a"),
    "corpus_rows": with_(CORPUS, "select query_id, source, config, role, gold, text_hash, length(prompt) as n from corpus"),
    "counts_by_source_role": with_(CORPUS, "select source, role, count(*) as n from corpus group by all"),
    "split_fingerprints": with_(CORPUS, "select role, count(*) as n, sha256(string_agg(query_id, chr(10) order by query_id)) as fingerprint from corpus group by role"),
    "text_leakage": with_(CORPUS, "select text_hash, count(distinct role) as n_roles from corpus group by text_hash having count(distinct role) > 1"),
    "corpus_check_violations": with_(CORPUS, """select 'duplicate_id' as "check", query_id as detail, count(*) as n from corpus group by query_id having count(*) > 1
        union all select 'empty_text', source, count(*) from corpus where prompt = '' or gold = '' or prompt is null group by source
        union all select 'role_overlap', query_id, count(distinct role) from corpus group by query_id having count(distinct role) > 1
        union all select 'text_leakage', text_hash, count(distinct role) from corpus group by text_hash having count(distinct role) > 1"""),
    "contam_benchmark": f"select doc_id, item_id from (select doc_id, {text_hash('text')} as h from documents) join (select item_id, {text_hash('text')} as h from benchmark) using (h)",
    "mc_prompt_build": with_(MC, "select n_nationkey, prompt from mcp"),
    "mc_prompt_parse": with_(MC, "select n_nationkey, stem as question, array_to_string(['A', 'B', 'C', 'D', 'E'][1:len(texts)], ',') as labels, array_to_string(texts, ',') as texts, true as same from mcp"),
    "arc_choice_norm": with_(MC, "select n_nationkey, case when n_nationkey % 7 = 0 then 'B' when n_nationkey % 7 = 1 then 'A' else chr((65 + key::int)::int) end as gold, len(texts) as n_choices from mc"),
    "hotpot_prompt_policies": with_(HOP, "select r_regionkey, ctx || chr(10) || chr(10) || question_only as full_context, ctx2 || chr(10) || chr(10) || question_only as gold_only, question_only from hp"),
    "hotpot_prompt_split": with_(HOP, """select r_regionkey, length(p) as n, 'What lies in ' || r_name || '?' as question, prefix, true as same from (
        select r_regionkey, r_name, ctx as prefix, ctx || chr(10) || chr(10) || question_only as p from hp union all select r_regionkey, r_name, ctx2, ctx2 || chr(10) || chr(10) || question_only from hp union all select r_regionkey, r_name, '', question_only from hp)"""),
    "mmlu_gold": "select p_partkey, case when p_partkey % 2 = 0 then chr((65 + p_partkey % 4)::int) else substr(p_brand, 1, 1) end as gold from part",
    "mmlu_dedup_first": "select min(p_partkey) as p_partkey, query_id from (select p_partkey, substr(sha256(concat_ws('|', p_brand, p_type, 'test', p_size::varchar)), 1, 24) as query_id from part) group by query_id",
    "sample_stratified": "select * from (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by md5('13|' || c_custkey), c_custkey) as turn from customer) order by turn, c_mktsegment limit 100",
    "sample_disjoint": "select c_custkey, case when rn <= 40 then 'calib' else 'fit' end as role from (select c_custkey, row_number() over (order by md5('5|' || c_custkey), c_custkey) as rn from customer) where rn <= 120",
    "head_limit": with_(CORPUS, "select query_id, role, doc_id from (select *, row_number() over (partition by role order by doc_id) as rn from corpus) where rn <= 8"),
    "feat_structural": with_(PHI, f"select doc_id, {all6(STRUCT)} from f4"),
    "feat_linguistic": with_(PHI, f"select doc_id, {', '.join(LING)} from f4"),
    "feat_conversations": with_(features("conversations", "conv_id, turn", "text"), "select conv_id, turn, n_requirements, domain_breadth, n_question_marks, n_sentences, prompt_token_len from f4"),
    "task_form": with_(MC, "select n_nationkey, case when n_nationkey % 3 = 0 then 'multi_hop_qa' else 'science_mc' end as task_type, (n_nationkey % 3 <> 0)::bigint as is_mc, case when n_nationkey % 3 = 0 then 0 else len(texts) end as n_choices from mc"),
    "flatten_numeric": with_(FLAT, f"select doc_id, feature, {r6('value', 'value')} from flat"),
    "zscore_fit": with_(ZSTATS, f"select feature, {all6(['mean', 'std'])} from zs"),
    "complexity_scores": with_(ZSTATS, f"""select doc_id, {all6(['C_length', 'C_density', 'C_atypical', 'C_linguistic'])}, {r6('(C_length + C_density + C_atypical + C_linguistic) / 4', 'C_query')} from (
        select doc_id, coalesce(max(z) filter (feature = 'structural.prompt_token_len'), 0) as C_length, coalesce(max(z) filter (feature = 'structural.mattr'), 0) as C_density, 0.0::double as C_atypical,
          coalesce(avg(z) filter (starts_with(feature, 'linguistic_cues.') and feature <> 'linguistic_cues.n_question_marks'), 0) as C_linguistic from (select doc_id, feature, (value - mean) / std as z from flat join zs using (feature)) group by doc_id)"""),
    "normalize_answer": f"select conv_id, turn, {normalized('text')} as answer from conversations",
    "paraphrase_surfaces": f"""with x as (select conv_id, turn, {trim("text")} as t, sha256(conv_id || '-' || turn) as h from conversations)
        select conv_id, turn, t as surface from x union all select conv_id, turn, {q(L.PARAPHRASE_PREFIXES)}[(('0x' || substr(h, i + 1, 2))::int + i) % 3 + 1] || ' ' || t from x, (values (1), (2)) v(i)""",
    "surface_prompts": with_(MC, f"""select query_id, no as surface_no, s || substr(prompt, length(stem) + 1) as surface_prompt from (select 'n' || n_nationkey as query_id, i::bigint as no, stem, prompt,
        case when i = 0 then stem else {q(L.PARAPHRASE_PREFIXES)}[(('0x' || substr(sha256('n' || n_nationkey), i + 1, 2))::int + i) % 3 + 1] || ' ' || stem end as s from mcp, (values (0), (1), (2)) v(i))"""),
    "centroid": with_(CENTER, f"select i - 1 as i, {r6('m', 'm')} from (select i, avg(v[i]) as m from vecs, range(1, 65) t(i) where vec_id % 5 < 3 group by i)"),
    "centroid_distance": with_(CENTER, f"select vec_id, {r6('1 - ' + DOT.format(a='v', b='c') + ' / (sqrt(' + DOT.format(a='v', b='v') + ') * sqrt(' + DOT.format(a='c', b='c') + '))', 'centroid_distance')} from vecs, cent"),
    "knn_similarity": with_(KNN, f"select vec_id, {r6('avg(1 - d)', 'mean_knn_similarity')} from near group by vec_id"),
    "pca_energy": with_(CENTER, f"select vec_id, {r6('list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))', 'energy')} from vecs, cent"),
    "lof_score": with_(LOF, f"select vec_id, {r6('lof', 'lof')}, {r6('(lof - m) / s', 'lof_score')} from lof, st"),
    **{f"mc_scores_{w}": with_(PROBES, f"select query_id, pred, {all6(['H', 'p_max', 'margin', 'top2_mass', 'perplexity_H', 'inv_p_max', 'surprisal'])}, n_options::bigint as n_options from {w}") for w in ("weak", "strong")},
    "stand_in_letters": f"""with x as (select 'documents|' || doc_id as q from documents), y as (select q, {SEED.format(salt="mc")} as seed from x),
        z as (select q, seed, list_transform([0, 1, 2, 3], lambda i: exp((((seed >> (5 * i)) % 97) + 1 + case when i = 0 then seed % 11 else 0 end) / 10.0::double)) as e from y)
        select q, seed, {", ".join(r6(f"e[{i + 1}] / list_sum(e)", f"p_{x}") for i, x in enumerate("ABCD"))} from z""",
    "stand_in_samples": f"""with x as (select 'documents|' || doc_id as q from documents), y as (select q, {SEED.format(salt="hotpot|0")} as seed from x)
        select q, {" || ',' || ".join(f"{q(L.SAMPLE_POOL)}[(seed + {3 * i}) % 5 + 1]" for i in range(3))} as samples from y""",
    "cluster_entropy": f"""with x as (select user_id, ts::date::varchar as day, event_type as a, count(*) as c, min(event_id) as pos from events group by all),
        y as (select user_id, day, sum(c)::bigint as n_samples, count(*) as n_clusters, list(c order by c desc, pos) as cs, first(a order by c desc, pos) as pred from x group by user_id, day)
        select user_id, day, n_samples, n_clusters, pred, {r6("-list_sum(list_transform(cs, lambda c: c / n_samples * ln(c / n_samples)))", "H")}, {r6("cs[1] / n_samples", "p_max")}, {r6("(cs[1] - coalesce(cs[2], 0)) / n_samples", "margin")}, {r6("(cs[1] + coalesce(cs[2], 0)) / n_samples", "top2_mass")} from y""",
    "paraphrase_u": f"""with x as (select user_id, event_type as a, count(*) as c, min(event_id) as pos from events group by all), y as (select user_id, sum(c)::bigint as k, max(c) as m, first(a order by c desc, pos) as mode from x group by user_id)
        select user_id, {r6("1 - m / k", "U")}, {r6("m / k", "agreement")}, k, mode from y""",
    "cost_trace": """select user_id, round(round(sum(value), 3), 1) as latency_ms, sum(event_id % 50)::bigint as prompt_tokens, sum(event_id % 7)::bigint as completion_tokens, sum(event_id % 50 + event_id % 7)::bigint as total_tokens,
        sum(case when event_id % 3 = 0 then event_id % 2 + 1 else 1 end)::bigint as n_calls, string_agg(event_type, ',' order by event_id) as kinds from events group by user_id""",
    "usd_estimate": """select conv_id, round(round((pt * case when conv_id % 2 = 0 then 0.25::double when conv_id % 3 = 0 then 0.05::double else 1.0::double end + ct * case when conv_id % 2 = 0 then 1.0::double when conv_id % 3 = 0 then 0.1::double else 3.0::double end) / 1e6, 8), 6) as usd_est
        from (select conv_id, sum(length(text)) as pt, count(*) as ct from conversations group by conv_id)""",
    "is_correct": with_(JOINED, "select vec_id, weak_ok as em, weak_ok as plain, is_mc as mc from joined"),
    "joined_rows": with_(JOINED, f"select query_id, role, source, is_mc, gold, weak_pred, strong_pred, weak_ok, strong_ok, weak_wrong, needs_strong, both_wrong, has_strong, {all6(FEATS)} from joined"),
    "z_vec": with_(JOINED, " union all ".join(f"select query_id, {i}::bigint as i, {r6(f, 'x')} from joined" for i, f in enumerate(FEATS))),
    "labels_contingency": with_(JOINED, "select role, count(*) filter (weak_ok and strong_ok) as both_right, count(*) filter (needs_strong) as needs_strong, count(*) filter (both_wrong) as both_wrong, count(*) filter (weak_ok and has_strong and not strong_ok) as strong_only_wrong from joined group by role"),
    "slices": with_(JOINED + ", " + sliced("joined", "s"), "select slice, count(*) as n from s group by slice"),
    "s1_accuracy": with_(JOINED + ", f as (select * from joined where role = 'fit'), " + sliced("f", "s"), f"select slice, count(*) as n, {r6('avg(weak_ok::int::double)', 'accuracy')} from s group by slice"),
    "s2_auroc": with_(
        JOINED + ", f as (select * from joined where role = 'fit'), " + sliced("f", "s") + f", lg as ({unpivoted('s', 'slice, weak_wrong', ['H', 'perplexity_H', 'p_max', 'surprisal', 'inv_p_max', 'margin', 'top2_mass'])}), au as ({auroc('lg', 'slice, feature', 'weak_wrong', f'value * {DIRS}')})",
        f"select slice, case when feature in ('H', 'perplexity_H') then 'entropy' when feature in ('p_max', 'surprisal', 'inv_p_max') then 'confidence' when feature = 'margin' then 'margin' else 'top2' end as family, feature as signal, ({DIRS})::bigint as direction, n, n_pos as n_wrong, {r6('auroc', 'auroc')}, feature in ('H', 'p_max', 'margin', 'top2_mass') as representative from au where n_pos > 0 and n_pos < n",
    ),
    "rank_features": with_(RANK, f"select slice, feature, direction::bigint as direction, {r6('auroc', 'auroc')}, {r6('1 - auroc', 'auroc_flipped')}, {r6('greatest(auroc, 1 - auroc)', 'best_auroc')}, n, n_pos from rk"),
    "rank_order": with_(RANK, "select feature, place from ord"),
    "feature_sets": with_(SETS, "select set, feature from sets"),
    "fit_zstats": with_(STATS, f"select feature, {all6(['mean', 'std'])} from fst"),
    "route_scores": with_(SCORES, f"select set, query_id, {r6('score', 'score')} from sc where role = 'eval'"),
    "sweep_curve": with_(CURVE, f"select set, {r6('tau', 'tau')}, tau_tag, {all6(['alpha', 'accuracy', 'pgr', 'r_weak', 'r_strong'])} from cv"),
    "pick_tau_cpt80": with_(CPT80, PICK),
    "pick_tau_cpt50": with_(CURVE + ", " + _cpt("0.5"), PICK),
    "pick_tau_alpha_max": with_(CURVE + ", " + ALPHA_MAX, PICK),
    "cpt_table": with_(CURVE, f"select set, {r6('min(alpha) filter (pgr >= 0.5)', 'cpt50')}, {r6('min(alpha) filter (pgr >= 0.8)', 'cpt80')} from cv group by set"),
    "eval_frozen": with_(EVAL, f"select set, slice, n, {all6(['alpha', 'accuracy'])}, {r6(PGR, 'pgr')}, {r6('mean_path_latency_ms', 'mean_path_latency_ms')} from ev"),
    "escalate": with_(EVAL, f"select set, query_id, {ESC} as escalated from es"),
    "alpha_drag": with_(EVAL, f"select p.set, {r6('p.alpha - m.alpha', 'drag')} from ev p join ev m on p.set = m.set where p.slice = 'pooled' and m.slice = 'mc_pooled'"),
    "curve_markers": with_(CPT80 + ", " + curve("ce", "eval"), f"""select set, {r6('tau_star', 'tau_star')}, {r6('calib_alpha', 'calib_alpha')}, {all6(['alpha', 'accuracy', 'pgr'])} from (
        select ce.set, pk.tau as tau_star, pk.alpha as calib_alpha, ce.alpha, ce.accuracy, ce.pgr, row_number() over (partition by ce.set order by abs(ce.tau - pk.tau), ce.idx) as rn from ce join pk on ce.set = pk.set where ce.tau_tag = 'threshold') where rn = 1"""),
    "curve_plot": with_(SCORES + ", " + curve("ce", "eval"), f"select set, {all6(['alpha', 'accuracy', 'pgr'])} from ce where tau_tag = 'threshold'"),
    "simple_rules": with_(JOINED, "select query_id, C_query >= 0.05 as c_only, H >= 0.9 or 1 - p_max >= 0.5 as h_or_u, H * 0.7 + C_query * 0.3 >= 0.5 as weighted from joined where role = 'eval'"),
    "corr_pearson": with_(JOINED + ", f as (select * from joined where role = 'fit')", " union all ".join(f"select '{a}' as a, '{b}' as b, {r6(f'corr({a}, {b})', 'r')} from f" for i, a in enumerate(FEATS) for b in FEATS[i + 1 :])),
    "corr_spearman": with_(JOINED + ", f as (select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double as {c}" for c in ("H", "C_length", "C_query", "margin")) + " from joined where role = 'fit')", "select " + ", ".join(r6(f"corr(H, {c})", f"H_{c}") for c in ("C_length", "C_query", "margin")) + " from f"),
    "entropy_tertile_error": with_(JOINED, f"select source, tertile, count(*) as n, {r6('avg(weak_wrong::int::double)', 'error')} from (select *, ntile(3) over (partition by source order by H, query_id) as tertile from joined where role = 'fit') group by source, tertile"),
    "signal_quantiles": with_(JOINED, f"select weak_ok, {r6('avg(H)', 'h_mean')}, {r6('quantile_cont(H, 0.25)', 'q25')}, {r6('quantile_cont(H, 0.5)', 'q50')}, {r6('quantile_cont(H, 0.75)', 'q75')}, {r6('avg(p_max)', 'p_mean')} from joined where role = 'fit' group by weak_ok"),
    "validation_signals": with_(JOINED + ", f as (select j.needs_strong, j.H - s.H as gap, 0.5 * j.C_query + 0.5 * j.H as joint from joined j join strong s on j.vec_id = s.vec_id where j.role = 'fit'), lg as (" + unpivoted("f", "needs_strong", ["gap", "joint"]) + f"), au as ({auroc('lg', 'feature', 'needs_strong', 'value')})", f"select feature, n, n_pos, {r6('auroc', 'auroc')} from au"),
    "verify_issues": with_(PROBES + ", r as (select query_id, source from strong union all select query_id, source from strong where source = 'src1')", """select 'row_count' as "check", (select count(*) from base)::varchar as detail, count(*) as n from r having count(*) <> (select count(*) from base)
        union all select 'source_count', e.source || ': ' || e.e, coalesce(g.g, 0) from (select source, count(*) as e from base group by source) e left join (select source, count(*) as g from r group by source) g using (source) where coalesce(g.g, 0) <> e.e
        union all select 'duplicate_ids', '', count(*) from (select query_id from r group by query_id having count(*) > 1) having count(*) > 0
        union all select 'missing_ids', '', count(*) from base where query_id not in (select query_id from r) having count(*) > 0
        union all select 'mock_backend', 'mock', 1 union all select 'manifest_count', '7', count(*) from r"""),
    "join_check": with_(JOINED, "select count(*) as joined, count(*) filter (has_strong) as with_strong from joined"),
    "validation_joint": with_(JOINED + ", j as (select * from joined where role = 'fit' and has_strong), js as (select avg(C_query) as mc, stddev_pop(C_query) as sc, avg(H) as mh, stddev_pop(H) as sh from j), jz as (select source, needs_strong as y, round(0.5 * (C_query - mc) / sc + 0.5 * (H - mh) / sh, 12) as s from j, js where C_query is not null), jr as (select *, rank() over (partition by source order by s) + (count(*) over (partition by source, s) - 1) / 2.0::double as r from jz)", f"select source, n, n_pos, {r6('(sr - n_pos * (n_pos + 1) / 2.0) / (n_pos * (n - n_pos))', 'auroc')} from (select source, count(*) as n, count(*) filter (y) as n_pos, sum(r) filter (y) as sr from jr group by source)"),
    "u_h_redundancy": f"with c as (select user_id, event_type, count(*) as c from events group by all), p as (select user_id, c, c / sum(c) over (partition by user_id) as p from c), x as (select user_id, 1 - max(p) as u, -sum(p * ln(p)) as h from p group by user_id) select count(*) as n, {r6('corr(u, h)', 'r')} from x",
    "level_correlation": with_(JOINED + ", l as (select *, (vec_id % 4)::double as level from joined where role = 'fit'), f as (select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double as {c}" for c in ("level", "C_length", "C_linguistic", "C_query")) + " from l)", "select " + ", ".join(r6(f"corr(level, {c})", c) for c in ("C_length", "C_linguistic", "C_query")) + " from f"),
    "weak_ablation": with_(JOINED + ", a as (select w.weak_wrong as y, w.H as hw, s.H as hs from joined w join strong s using (vec_id) where w.role = 'fit'), al as (select 'H' as feature, y, hw as s from a union all select 'H_strong', y, hs from a), ar as (select *, rank() over (partition by feature order by s) + (count(*) over (partition by feature, s) - 1) / 2.0::double as r from al)", f"select feature, n, n_pos, {r6('(sr - n_pos * (n_pos + 1) / 2.0) / (n_pos * (n - n_pos))', 'auroc')} from (select feature, count(*) as n, count(*) filter (y) as n_pos, sum(r) filter (y) as sr from ar group by feature)"),
    "fit_violations": with_(BASE, "select 'evaluation_rows' as \"check\", count(*) as n from base where source = 'src1' and role = 'eval' having count(*) > 0 union all select 'outside_fit', count(*) from base where source = 'src1' and role <> 'fit' having count(*) > 0"),
    "incomplete_rows": with_(JOINED, "select source, count(*) as n from joined where not has_strong group by source"),
    "model_roles": with_(PROBES, "select 'weak' as model_role, count(*) as n from weak union all select 'strong', count(*) from strong"),
    "latest_backup_prune": f"select * from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as age from orders) where age > {L.BACKUPS_KEPT}",
    "joined_last_wins": with_(JOINED, "select query_id, weak_pred, strong_pred, weak_ok, needs_strong from joined"),
    "eval_by_slice": with_(EVAL, f"select set, slice, n, {all6(['alpha', 'accuracy'])}, {r6(PGR, 'pgr')} from ev where slice <> 'pooled'"),
    "path_latency": with_(EVAL, f"select set, {r6('mean_path_latency_ms', 'mean_path_latency_ms')} from ev where slice = 'pooled'"),
    "random_escalation": with_(JOINED, "select query_id, ('0x' || substr(md5('42|' || query_id), 1, 8))::bigint < 0.3 * 4294967296 as escalated from joined where role = 'eval'"),
    "complexity_geometry": with_(GEOMETRY, f"select vec_id, {all6(['C_length', 'C_density', 'C_atypical', 'C_linguistic'])}, {r6('(C_length + C_density + C_atypical + C_linguistic) / 4', 'C_query')} from gc"),
    "probe_records": with_(MC, PROBE_RECORDS),
    "upsert": "with n as (select l_orderkey as query_id, max(l_linestatus) as state from lineitem group by 1) select o_orderkey as query_id, o_orderstatus as state from orders where o_orderkey not in (select query_id from n) union all select * from n",
    "resume_todo": "select o_orderkey as query_id from orders where o_orderkey not in (select l_orderkey from lineitem where l_linestatus = 'F')",
    "last_duplicate_wins": "select o_custkey, max(o_orderkey) as o_orderkey, arg_max(o_orderpriority, o_orderkey) as o_orderpriority from orders group by o_custkey",
}
