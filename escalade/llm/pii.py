"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score. DataFrame functions only.

Kinds, in order: email, ip, card, phone (the base kinds), iban, ssn. Matches are leftmost and non-overlapping per
kind; a match that fails its check is dropped and not retried. Each span has kind, start, end (code points, end exclusive), value and score. Base
spans are always kept; ibans need mod-97 and ssns a context word, so for those the score decides.

Positions come from splitting the text at the matches of the same pattern: a match starts after the lengths of all
pieces and matches before it. Look-behinds and possessive quantifiers keep long runs linear and change no match.

Defined results: null text counts as empty and has no spans; repeated rows get equal results each; empty tables give
empty results; other columns are passed through, one that has the name of `out` is replaced. Ids are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The published lengths of IBANs by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
CONTEXT = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "address", "host", "server"), "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "call", "tel", "mobile"), "iban": ("iban", "account", "bank", "transfer"), "ssn": ("ssn", "social", "security"),
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
CONTEXT_CHARS = 40
BONUS = 0.25
LEAST = 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _mod97(value: Column) -> Column:
    """Remainder of an IBAN's rearranged number, letters as 10 to 35, digit by digit."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, ch: F.when(ch == "", a).otherwise(step(a, ch)).cast("int"))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = F.length(_digits(value))
        return (n >= 12) & (n <= 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        n = F.length(_digits(value))
        return (n >= 9) & (n <= 15)
    if kind == "iban":
        return _mod97(value) == 1
    if kind == "ssn":
        return ~F.substring(value, 1, 3).isin("000", "666") & (F.substring(value, 1, 1) != "9") & (F.substring(value, 5, 2) != "00") & (F.substring(value, 8, 4) != "0000")
    return F.lit(True)


def _confirmed(kind: str, text: Column) -> Column:
    """array<struct<start, end, value>> of a pattern's matches that pass its check; nothing is split where the pattern has no match.

    One pass carries the position; only confirmed matches are appended, so a text full of failing ones stays linear.
    """
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    pieces = F.split(text, PATTERNS[kind], -1)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + pair["skip"]
        end = begin + F.length(pair["m"])
        grown = F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), pair["m"].alias("value"))))
        return F.struct(end.alias("at"), F.when(pair["valid"], grown).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda m, p: F.struct(F.length(p).alias("skip"), m.alias("m"), _valid(kind, m).alias("valid")))
    return F.when(F.regexp_like(text, F.lit(PATTERNS[kind])), F.aggregate(pairs, start, step, lambda a: a["out"])).otherwise(empty)


def _score(kind: str, text: Column, start: Column, end: Column) -> Column:
    """Prior of the kind, raised where one of its words stands within CONTEXT_CHARS code points."""
    before = F.substring(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS)))
    near = F.lower(F.concat_ws(" ", before, F.substring(text, end + 1, F.lit(CONTEXT_CHARS))))
    return F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(F.regexp_like(near, F.lit(r"\b(?:" + "|".join(CONTEXT[kind]) + ")")), F.lit(BONUS)).otherwise(F.lit(0.0)))


def spans_of(kind: str, text: Column) -> Column:
    scored = F.transform(_confirmed(kind, text), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value"), _score(kind, text, s["start"], s["end"]).alias("score")))
    return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= LEAST)


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with `out`, an array of spans sorted by start, then kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    cols = {f"__{k}": spans_of(k, whole) for k in KINDS}
    return docs.withColumns(cols).withColumn(out, F.array_sort(F.concat(*[F.col(c) for c in cols]))).drop(*cols)


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets; overlapping spans merge under the first one's kind. Null text stays null."""
    found = find_pii(docs, text, "__pii")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])
        grown = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(kept, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out"))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(grown)

    rest = F.aggregate("__pii", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col(text), a["at"] + 1, F.length(F.col(text)))))
    return found.withColumn(text, F.when(F.col(text).isNull() | (F.size("__pii") == 0), F.col(text)).otherwise(rest)).drop("__pii")
