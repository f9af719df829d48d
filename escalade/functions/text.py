"""Text functions as column expressions."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import lexicon as L

OPTION_LINE = r"(?dm)^([A-E])\.\s+(.*)$"
SPACE = r"(?U)[\s\x1c-\x1f]+"


def trim(c: Column) -> Column:
    """Strips all Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def spaced(c: Column) -> Column:
    """What white space separates."""
    return F.regexp_extract_all(c, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


def words(c: Column) -> Column:
    """Lower-cased word tokens."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?U)\b[\w']+\b"), F.lit(0)), F.lower)


def sha_hex(c: Column, n: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def text_hash(c: Column) -> Column:
    """Hash of lower-cased text with white space collapsed, 16 hex digits."""
    return sha_hex(F.lower(F.trim(F.regexp_replace(c, SPACE, " "))), 16)


def query_id(source: Column, config: Column, split: Column, raw_id: Column) -> Column:
    return sha_hex(F.concat_ws("|", source, config, split, raw_id.cast("string")), 24)


def occurrences(c: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a phrase."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def option_texts(prompt: Column) -> Column:
    return F.transform(F.regexp_extract_all(prompt, F.lit(OPTION_LINE), F.lit(2)), trim)


def option_labels(prompt: Column) -> Column:
    return F.regexp_extract_all(prompt, F.lit(OPTION_LINE), F.lit(1))


def without_brief_suffix(c: Column) -> Column:
    return trim(F.regexp_replace(c, rf"\n\n?{L.BRIEF_SUFFIX[:-1]}\.$", ""))


def free_question(prompt: Column) -> Column:
    """The question of a prompt without options: what follows the last question marker."""
    q = F.when(prompt.startswith("Question:"), trim(F.substring(prompt, 10, 2**31 - 1))).when(prompt.contains(L.QUESTION_MARKER), trim(F.substring_index(prompt, L.QUESTION_MARKER, -1))).otherwise(prompt)
    return F.when(F.regexp_like(q, F.lit(rf"\n{L.BRIEF_SUFFIX[:-1]}\.$")), without_brief_suffix(q)).otherwise(q)


def context_prefix(prompt: Column) -> Column:
    """Text before the last question marker, empty where there is none."""
    has = ~prompt.startswith("Question:") & prompt.contains(L.QUESTION_MARKER)
    size = F.length(prompt) - F.length(F.substring_index(prompt, L.QUESTION_MARKER, -1)) - len(L.QUESTION_MARKER)
    return F.when(has, trim(F.substring(prompt, F.lit(1), size))).otherwise(F.lit(""))


def question(prompt: Column) -> Column:
    """Stem of a multiple-choice prompt, or the question of another one."""
    labels = option_labels(prompt)
    first = F.get(labels, F.lit(0))
    at_line, at_any = (F.call_function("instr", prompt, F.concat(F.lit(lead), first, F.lit(". "))) for lead in ("\n", ""))
    at = F.when(at_line > 0, at_line).otherwise(at_any)
    stem = F.when(at > 0, trim(F.substring(prompt, F.lit(1), at - 1))).otherwise(prompt)
    stem = trim(F.replace(stem, F.lit(L.MC_INSTRUCTION), F.lit("")))
    return F.when(F.size(labels) > 0, stem).otherwise(free_question(prompt))


def mc_prompt(stem: Column, choices: Column) -> Column:
    """Choices labelled from A on."""
    lines = F.transform(choices, lambda t, i: F.concat(F.char(i + 65), F.lit(". "), t))
    return F.concat_ws("\n", trim(stem), F.lit(""), lines, F.lit(""), F.lit(L.MC_INSTRUCTION))


def labelled_prompt(stem: Column, labels: Column, texts: Column) -> Column:
    lines = F.zip_with(labels, texts, lambda a, t: F.concat(a, F.lit(". "), t))
    return F.concat_ws("\n", trim(stem), F.lit(""), lines, F.lit(""), F.lit(L.MC_INSTRUCTION))


def free_prompt(prefix: Column, q: Column) -> Column:
    block = F.concat(F.lit("Question: "), trim(q), F.lit(f"\n\n{L.BRIEF_SUFFIX}"))
    return F.when(prefix != "", F.concat(F.regexp_replace(prefix, r"(?U)\s+$", ""), F.lit("\n\n"), block)).otherwise(block)


def normalized_answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.translate(F.lower(c), L.PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), SPACE, " "))


def is_correct(pred: Column, gold: Column, metric: Column) -> Column:
    return F.when(metric == "em", normalized_answer(pred) == normalized_answer(gold)).otherwise(F.upper(trim(pred)) == F.upper(trim(gold)))


def hits(lexicon: list[str], text: Column) -> Column:
    """How many entries are substrings of a lower-case text; tokens are substrings too."""
    return F.size(F.filter(F.array(*[F.lit(w) for w in lexicon]), lambda w: F.contains(text, w)))


def domain_breadth(text: Column) -> Column:
    one = lambda terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t)).cast("int")
    total = F.lit(0)
    for terms in L.DOMAINS.values():
        total = total + one(terms)
    return total


def bloom_depth(stem_tokens: Column, stem_lower: Column) -> Column:
    """Highest level with a phrase in the text or a verb among the tokens, 0 if none."""
    any_phrase = lambda ps: F.exists(F.array(*[F.lit(p) for p in ps]), lambda p: F.contains(stem_lower, p))
    levels = [F.when(any_phrase(L.APPLY_PHRASES), L.BLOOM_LEVELS["apply"]).otherwise(0), F.when(any_phrase(L.CREATE_PHRASES), L.BLOOM_LEVELS["create"]).otherwise(0)]
    levels += [F.when(F.arrays_overlap(stem_tokens, F.array(*[F.lit(v) for v in verbs])), L.BLOOM_LEVELS[k]).otherwise(0) for k, verbs in L.BLOOM.items()]
    return F.greatest(*levels)


def requirements(prompt: Column) -> Column:
    lower = F.lower(prompt)
    total = F.size(F.regexp_extract_all(prompt, F.lit(f"(?U){L.ENUMERATED_STEP}"), F.lit(0)))
    for m in L.REQUIREMENT_MARKERS:
        total = total + occurrences(lower, m)
    return total


def sentences(stem: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.filter(F.split(stem, r"[.!?]+"), lambda s: trim(s) != "")))


@F.pandas_udf(DoubleType())
def _mattr(tokens: pd.Series, window: pd.Series) -> pd.Series:
    """Each token adds one to every window in which it is the first of its kind: linear in the tokens."""
    out = []
    for toks, w in zip(tokens, window, strict=True):
        n = 0 if toks is None else len(toks)
        if n == 0:
            out.append(float("nan"))
        elif n < w:
            out.append(len(set(toks)) / n)
        else:
            last: dict[str, int] = {}
            total, final = 0, n - w
            for i, t in enumerate(toks):
                low = max(last.get(t, -1) + 1, i - w + 1)
                high = i if i < final else final
                if high >= low:
                    total += high - low + 1
                last[t] = i
            out.append(total / w / (final + 1))
    return pd.Series(out, dtype="float64")


def mattr(tokens: Column, window: int = L.MATTR_WINDOW) -> Column:
    """Moving-average type-token ratio; null without tokens."""
    return _mattr(tokens, F.lit(window))


@F.pandas_udf(DoubleType())
def _compression(texts: pd.Series, level: pd.Series) -> pd.Series:
    data = [(t or "").encode() for t in texts]
    return pd.Series([len(zlib.compress(d, int(k))) / len(d) if d else float("nan") for d, k in zip(data, level, strict=True)], dtype="float64")


def compression_ratio(c: Column, level: int = L.ZLIB_LEVEL) -> Column:
    """zlib size over UTF-8 size; null for empty text. zlib has no built-in."""
    return _compression(c, F.lit(level))


def paraphrase_surfaces(q: Column, k: int, qid: Column) -> Column:
    """The stripped question and k - 1 prefixed forms chosen by the id's hash."""
    h = F.sha2(qid, 256)
    prefixes = F.array(*[F.lit(p) for p in L.PARAPHRASE_PREFIXES])
    forms = [F.concat(F.element_at(prefixes, ((F.conv(F.substring(h, i + 1, 2), 16, 10).cast("int") + i) % len(L.PARAPHRASE_PREFIXES)) + 1), F.lit(" "), trim(q)) for i in range(1, max(1, k))]
    return F.array(trim(q), *forms)
