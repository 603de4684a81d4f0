"""Personal data: base patterns, and candidates judged by gradient-boosted trees.

High-recall generators propose spans, which may overlap; each is described by its
format and by the words on both sides of it, scored by boosted trees and accepted
beyond a threshold calibrated on held-out examples. Everything on the way of a document
is DataFrame expressions: patterns give the pieces between matches and the matches,
their running lengths are positions in code points, and the trees are CASE
expressions. No row is shuffled; a document's spans are an array in its own row.

Arrays grow by copying, so running sums and sweeps go over blocks of a fixed number
of spans: their time grows with the number of spans of a text, up to a million of
them. The patterns are written with possessive quantifiers where the language they
match is the same, so that long runs of digits or letters cost linear time and no stack.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.boosting import Boosted, calibrated_threshold, fit
from quire.llm.common import fresh
from quire.llm.pii_examples import Example, examples

BASE = ["email", "ip", "card", "phone"]
_LOCAL = "A-Za-z0-9._%+-"
BASE_PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further kinds, in the order in which the result lists them.
GENERATORS = {
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "birth": r"(?<![0-9./-])(?:[0-9]{4}[./-][0-9]{2}[./-][0-9]{2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})(?![0-9./-])",
    "local_phone": r"(?<![0-9+().-])[0-9(](?:[\x20().-]?[0-9]){7,15}+(?![0-9])",
    "spelled_email": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{1,40}+(?:\x20\[?at\]?\x20|\(at\))[a-z0-9-]{1,40}+(?:\x20dot\x20|\[dot\]|\(dot\))[a-z]{2,10}",
    # keys that their first characters give away, web tokens of three parts, and the first line of a private key
    "known_key": r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}|AIza[A-Za-z0-9_-]{35}|xox[abeoprs]-[A-Za-z0-9-]{10,200}|gh[oprsu]_[A-Za-z0-9]{20,255}|glpat-[A-Za-z0-9_-]{20,64}|[ps]k_live_[A-Za-z0-9]{16,255}|eyJ[A-Za-z0-9_-]{8,4000}\.eyJ[A-Za-z0-9_-]{8,4000}(?:\.[A-Za-z0-9_-]{0,4000})?)(?![A-Za-z0-9_-])|-----BEGIN\x20[A-Z\x20]{0,20}PRIVATE\x20KEY-----",
    # the alphabet with / and +, which the one above has not
    "base64_key": r"(?<![A-Za-z0-9+/=._-])(?=[A-Za-z0-9]*+[+/])(?=[A-Za-z+/]*+[0-9])[A-Za-z0-9+/]{20,200}+={0,2}(?![A-Za-z0-9+/=._-])",
    "identity": r"(?<![A-Za-z0-9_-])(?=[0-9]*+[A-Z])(?=[A-Z]*+[0-9][A-Z]*+[0-9])[A-Z0-9]{7,12}+(?![A-Za-z0-9_-])",
    "password": r"(?i)(?:(?<=password is )|(?<=password: )|(?<=password = )|(?<=password=)|(?<=passwort ist )|(?<=passwort: )|(?<=passwd: )|(?<=passwd=)|(?<=passcode is )|(?<=pwd: )|(?<=pwd=))[^\x20\x09-\x0D\"',;<>()]{5,63}[^\x20\x09-\x0D\"',;<>().!?:]",
}
#: What a document needs for a pattern to be tried at all.
NEEDS = {"email": "@", "phone": "\\+[0-9]", "ip": "[0-9]\\.[0-9]", "spelled_email": "(?i)at", "password": "(?i)passw|passcode|pwd", "known_key": "AKIA|ASIA|AROA|AIDA|AIza|xox|gh[oprsu]_|glpat-|k_live_|eyJ|PRIVATE KEY", "base64_key": "[+/]"}
PRECISION = 0.97
CONTEXT_CHARS = 24
#: What stands around a span only counts within its clause.
BEFORE_CLAUSE = r"(?s)^.*(?:[;\n]|, |[.!?] (?=[A-Z]))"
CLAUSE = r"[^,.;\n]*"
CONTEXT_WORDS = {
    "secret": "token|key|secret|password|passwd|bearer|credential",
    "id": "ssn|social|taxpayer|passport|identity|id card|licen[cs]e no",
    "bank": "iban|bank|account|konto|pay to|transfer",
    "birth": "born|birth|dob|geboren",
    "phone": "call|phone|tel|mobile|fax",
    "mail": "mail|contact|write to",
    "other": "isbn|order|invoice|version|part|serial|commit|checksum|sha|ref|page|item|total|model|code|figure",
}
#: The same as whole words: what follows a span is often plain text, in which a part of a word means nothing.
WORDS_BEHIND = {k: rf"(?:^|[^a-z0-9])(?:{p})(?:s|[0-9]+)?(?:[^a-z0-9]|$)" for k, p in CONTEXT_WORDS.items()}
FEATURES = ["kind", "n", "digits", "letters", "upper", "separators", "groups", "distinct", "hex", "quoted", "check", "lower_words", *CONTEXT_WORDS, *(f"{k}_behind" for k in CONTEXT_WORDS)]
#: Spans that a block of a running sum or a sweep has.
BLOCK = 64


def iban_check(text: str) -> int:
    """The remainder modulo 97 of an account number's characters, the first four put last; 1 if its check digits are right. 0 for other text."""
    c = text.replace(" ", "")
    if not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", c):
        return 0
    return int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97


def _iban_check(text: Column) -> Column:
    c = F.regexp_replace(text, " ", "")
    chars = F.filter(F.split(F.concat(F.substring(c, F.lit(5), F.char_length(c)), F.substring(c, 1, 4)), ""), lambda x: x != "")
    value = lambda x: F.when(x.rlike("[0-9]"), x.try_cast("int")).otherwise(F.ascii(x) - 55)
    rest = F.aggregate(chars, F.lit(0), lambda acc, x: (acc * F.when(x.rlike("[0-9]"), 10).otherwise(100) + value(x)) % 97)
    return F.when(c.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest).otherwise(0)


def python_features(e: Example) -> list[float]:
    left, right = re.sub(BEFORE_CLAUSE, "", e.left[-CONTEXT_CHARS:]).lower(), re.match(CLAUSE, e.right[:CONTEXT_CHARS].lower()).group()
    count = lambda p: float(len(re.findall(p, e.text)))
    return [
        float(list(GENERATORS).index(e.kind)), float(len(e.text)), count("[0-9]"), count("[A-Za-z]"), count("[A-Z]"), count(r"[\x20().,/:_-]"), count("[0-9]+"), float(len(set(e.text))),
        float(bool(re.fullmatch("[0-9a-fA-F]+", e.text))), float(left.endswith(('"', "'", "=", ": "))), float(iban_check(e.text) == 1), count("[a-z]{4,}"), *(float(bool(re.search(p, left))) for p in CONTEXT_WORDS.values()), *(float(bool(re.search(p, right))) for p in WORDS_BEHIND.values()),
    ]


def column_features(kind: int, text: Column, before: Column, behind: Column) -> list[Column]:
    left, right = F.lower(F.regexp_replace(_tail(before), F.lit(BEFORE_CLAUSE), F.lit(""))), F.regexp_extract(F.lower(_head(behind)), CLAUSE, 0)
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("double")
    flag = lambda c: c.cast("double")
    return [
        F.lit(float(kind)), F.char_length(text).cast("double"), count("[0-9]"), count("[A-Za-z]"), count("[A-Z]"), count(r"[\x20().,/:_-]"), count("[0-9]+"), F.size(F.array_distinct(F.split(text, ""))).cast("double"),
        flag(text.rlike("^[0-9a-fA-F]+$")), flag(left.endswith('"') | left.endswith("'") | left.endswith("=") | left.endswith(": ")), flag(_iban_check(text) == 1) if kind == list(GENERATORS).index("iban") else F.lit(0.0), count("[a-z]{4,}"), *(flag(left.rlike(p)) for p in CONTEXT_WORDS.values()), *(flag(right.rlike(p)) for p in WORDS_BEHIND.values()),
    ]


def _head(text: Column) -> Column:
    return F.substring(text, 1, CONTEXT_CHARS)


def _tail(text: Column) -> Column:
    return F.substring(text, -CONTEXT_CHARS, CONTEXT_CHARS)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with a variable for value: evaluated once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _blocks(rows: Column) -> Column:
    """A non-empty array in blocks."""
    return _let(rows, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))


def running_sums(lengths: Column) -> Column:
    """array<int>: the sum of the first k lengths for k = 1 .. n, of a non-empty array."""
    zero = F.array(F.lit(0))
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))

    def joined(inner: Column) -> Column:  # running sums of each block, a zero before
        offsets = F.aggregate(F.transform(inner, lambda p: F.element_at(p, -1)), zero, grow)
        return F.flatten(F.zip_with(inner, F.slice(offsets, F.lit(1), F.size(inner)), lambda p, o: F.transform(F.slice(p, F.lit(2), F.lit(BLOCK)), lambda v: v + o)))

    return _let(F.transform(_blocks(lengths), lambda block: F.aggregate(block, zero, grow)), joined)


def _swept(rows: Column, state: Column, step: Callable[[Column, Column], Column], last: Callable[[Column], Column]) -> Column:
    """aggregate over a non-empty array with a state of end, open and a growing array out; out is gathered block by block."""
    none = F.array().cast(f"array<{SPAN}>")
    start = F.struct(state["end"].alias("end"), state["open"].alias("open"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    gathered = lambda end, open_, out: F.struct(end.alias("end"), open_.alias("open"), out.alias("out"))
    inner = lambda acc, block: F.aggregate(block, gathered(acc["end"], acc["open"], none), step, lambda r: gathered(r["end"], r["open"], F.concat(acc["out"], F.array(r["out"]))))
    return F.aggregate(_blocks(rows), start, inner, lambda acc: last(gathered(acc["end"], acc["open"], F.flatten(acc["out"]))))


@lru_cache(maxsize=1)
def model() -> tuple[dict[str, Boosted], dict[str, float]]:
    """The trees of each kind, fitted on two thirds of its labelled candidates, and a margin for each calibrated on the rest."""
    rows = examples(GENERATORS)
    trees, least = {}, {}
    for kind in GENERATORS:
        own = [e for e in rows if e.kind == kind]
        x, y = np.array([python_features(e) for e in own]), np.array([e.label for e in own], float)
        held = np.arange(len(own)) % 3 == 0
        trees[kind] = fit(x[~held], y[~held])
        least[kind] = max(0.0, calibrated_threshold(trees[kind].margins(x[held]), y[held], PRECISION))
    return trees, least


MATCH = "struct<start:int,end:int,text:string,before:string,behind:string>"


def _matches(text: Column, pattern: str, needs: str | None, context: bool = False) -> Column:
    """array of MATCH: the leftmost non-overlapping matches, offsets in code points; with up to CONTEXT_CHARS of the text on either side, if wanted."""

    def around(found: Column, pieces: Column, k: Column) -> tuple[Column, Column]:
        # A match has six characters at least, so four of them and the pieces between fill a context.
        part = lambda array, j: F.coalesce(F.get(array, j), F.lit(""))
        before = [x for j in (4, 3, 2, 1) for x in (part(found, k - j), _tail(part(pieces, k - j + 1)))]
        behind = [x for j in (1, 2, 3, 4) for x in (_head(part(pieces, k + j)), part(found, k + j))]
        return _tail(F.concat(*before)), _head(F.concat(*behind))

    def placed(found: Column, pieces: Column) -> Column:
        sums = running_sums(F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.char_length(p) + F.char_length(m)))

        def match(end: Column, k: Column) -> Column:
            m = F.get(found, k)
            before, behind = around(found, pieces, k) if context else (F.lit(""), F.lit(""))
            return F.struct((end - F.char_length(m)).alias("start"), end.alias("end"), m.alias("text"), before.alias("before"), behind.alias("behind"))

        return F.when(F.size(found) > 0, F.transform(sums, match)).otherwise(F.array().cast(f"array<{MATCH}>"))

    spans = _let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: _let(F.split(text, pattern, -1), lambda pieces: placed(found, pieces)))
    return F.when(text.rlike(needs or "[0-9]"), spans).otherwise(F.array().cast(f"array<{MATCH}>"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        doubled = d * 2
        return acc + F.when(i % 2 == 0, d).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), step) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":  # leading zeros do not count
        return F.forall(F.split(m["text"], "\\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.char_length(_digits(m["text"]))
    if kind == "card":
        return n.between(13, 19) & _luhn(_digits(m["text"]))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def _span(kind: str, order: int, m: Column, score: Column) -> Column:
    return F.struct(m["start"].alias("start"), F.lit(order).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"))


def base_spans(text: Column) -> Column:
    """array of SPAN of the base kinds, as listed, then by start."""
    found = []
    for k, kind in enumerate(BASE):
        valid = F.filter(_matches(text, BASE_PATTERNS[kind], NEEDS.get(kind)), lambda m: _valid(kind, m))
        found.append(F.transform(valid, lambda m: _span(kind, k, m, F.lit(1e9))))
    return F.concat(*found)


def method_candidates(text: Column) -> Column:
    """Accepted candidates of the generators, of the same type; they may still overlap."""
    trees, least = model()
    found = []
    for k, kind in enumerate(GENERATORS):
        scored = F.transform(_matches(text, GENERATORS[kind], NEEDS.get(kind), True), lambda m: _span(kind, len(BASE) + k, m, _margin(trees[kind], column_features(k, m["text"], m["before"], m["behind"]))))
        found.append(F.filter(scored, lambda s: s["score"] >= least[kind]))
    return F.concat(*found)


def _margin(boosted: Boosted, features: list[Column]) -> Column:
    """The trees over features that are evaluated once."""
    return _let(F.array(*features), lambda f: boosted.margin([F.get(f, F.lit(k)) for k in range(len(features))]))


def _better(a: Column, b: Column) -> Column:
    return (a["score"] > b["score"]) | ((a["score"] == b["score"]) & (a["rank"] < b["rank"]))


def resolved(base: Column, extra: Column) -> Column:
    """base, then of extra (by rank and start) what remains of two sweeps.

    From right to left, a candidate behind whose start a base span begins before it ends goes. From left to
    right, so does one that begins inside a base span; of two others that overlap, the one with the higher score
    stays (then the earlier kind, then the earlier start) and meets the next.
    """
    none = F.lit(None).cast(SPAN)
    is_base = lambda s: s["rank"] < len(BASE)
    state = lambda end, open_, out: F.struct(end.alias("end"), open_.alias("open"), out.alias("out"))

    def leftwards(acc: Column, s: Column) -> Column:
        stays = is_base(s) | (s["end"] <= acc["end"])
        return state(F.when(is_base(s), s["start"]).otherwise(acc["end"]), none, F.when(stays, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]))

    def rightwards(acc: Column, s: Column) -> Column:
        done = acc["open"].isNotNull() & (acc["open"]["end"] <= s["start"])
        still = acc["open"].isNotNull() & ~done
        open_ = F.when(is_base(s), F.when(still, acc["open"])).when(s["start"] < acc["end"], F.when(still, acc["open"])).when(still & ~_better(s, acc["open"]), acc["open"]).otherwise(s)
        return state(F.when(is_base(s), F.greatest(acc["end"], s["end"])).otherwise(acc["end"]), open_, F.when(done, F.concat(acc["out"], F.array(acc["open"]))).otherwise(acc["out"]))

    first = F.struct(F.lit(2147483647).alias("end"), none.alias("open"))
    second = F.struct(F.lit(0).alias("end"), none.alias("open"))
    free = _swept(F.reverse(F.array_sort(F.concat(base, extra))), first, leftwards, lambda acc: F.reverse(acc["out"]))
    kept = _let(free, lambda spans: _swept(spans, second, rightwards, lambda acc: F.when(acc["open"].isNotNull(), F.concat(acc["out"], F.array(acc["open"]))).otherwise(acc["out"])))
    by_rank = F.transform(F.array_sort(F.transform(kept, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s.alias("s")))), lambda x: x["s"])
    return F.when(F.size(extra) == 0, base).otherwise(F.concat(base, by_rank))


def with_spans(docs: DataFrame, base: str, spans: str) -> DataFrame:
    """docs with the base spans and all spans under these names; the arrays are computed once, each in its own projection."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some = text.rlike("[0-9@]|(?i)[\\x20\\[(]at[\\x20\\])]|passw|passcode|pwd|PRIVATE KEY")
    none = F.array().cast(f"array<{SPAN}>")
    extra = fresh(docs, base, spans, "pii_extra")[2]
    step = docs.withColumn(base, F.when(some, base_spans(text)).otherwise(none)).withColumn(extra, F.when(some, method_candidates(text)).otherwise(none))
    return step.withColumn(spans, resolved(F.col(base), F.col(extra))).drop(extra)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs (doc_id, text, ...).

    Counts and base_sha256 are of the base kinds alone; spans lists these and the accepted candidates.
    Null and empty texts have no spans. Repeated rows stay, a null doc_id stays null, other columns are
    ignored (a column named like a result is not read), an empty table gives no rows.
    """
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "pii_base", "pii_spans")
    count = lambda kind: F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(_listed(F.col("pii_base")), 256).alias("base_sha256"), _listed(F.col("pii_spans")).alias("spans"))


def _merged(spans: Column) -> Column:
    """A non-empty array of spans by start, overlapping ones as one with the kind of the first."""
    none = F.lit(None).cast(SPAN)

    def step(acc: Column, s: Column) -> Column:
        meets = acc["open"].isNotNull() & (s["start"] < acc["end"])
        wide = acc["open"].withField("end", F.greatest(acc["end"], s["end"]))
        out = F.when(acc["open"].isNotNull() & ~meets, F.concat(acc["out"], F.array(acc["open"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), F.when(meets, wide).otherwise(s).alias("open"), out.alias("out"))

    return _swept(F.array_sort(spans), F.struct(F.lit(0).alias("end"), none.alias("open")), step, lambda acc: F.concat(acc["out"], F.array(acc["open"])))


def redacted(text: Column, spans: Column) -> Column:
    """text with each span as [KIND]; each block of spans reads its own stretch of the text."""

    def whole(merged: Column) -> Column:
        starts = F.concat(F.transform(F.slice(merged, F.lit(2), F.size(merged)), lambda s: s["start"]), F.array(F.char_length(text)))
        return F.concat(F.substring(text, F.lit(1), merged[0]["start"]), F.array_join(F.transform(_blocks(F.zip_with(merged, starts, lambda s, n: s.withField("rank", n))), stretch), ""))

    def stretch(block: Column) -> Column:  # rank is where the next span starts
        first = block[0]["start"]
        own = F.substring(text, first + 1, F.element_at(block, -1)["rank"] - first)
        mark = lambda s, t: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"), F.substring(t, s["end"] - first + 1, s["rank"] - s["end"]))
        return _let(own, lambda t: F.array_join(F.transform(block, lambda s: mark(s, t)), ""))

    return F.when(F.size(spans) > 0, _let(_merged(spans), whole)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by [KIND] and n_chars set to the new length; overlapping base spans are one.

    Null texts stay null; all other columns and rows are unchanged.
    """
    names = docs.columns
    base, spans = fresh(docs, "pii_base", "pii_spans")
    found = with_spans(docs, base, spans)
    out = found.withColumn("text", redacted(F.col("text"), F.col(spans))).drop(base, spans)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*names)
