"""Text functions with code-point semantics: white space, lines, punctuation, markup and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: Unicode white space as a regular-expression class, understood by Java and RE2 alike.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STRIP = rf"^[{SPACE}]+|[{SPACE}]+\z"
#: The same characters one by one.
SPACES = "".join(chr(k) for k in range(0x3001) if chr(k).isspace())
#: Lines of text mode: line feed, carriage return or both.
LINE_BREAK = r"\r\n|\r|\n"
#: Lines as Unicode has them: also vertical tab, form feed, the information separators, U+0085, U+2028 and U+2029.
UNICODE_BREAK = r"\r\n|[\n\r\x0b\x0c\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
#: White space of a regular expression's \s in ASCII mode.
ASCII_SPACE = r"\t\n\f\r "
UNSET = "未填"
INDENT = "　　"


def strip(c: Column) -> Column:
    """Without white space at both ends, in the Unicode sense (trim() takes ASCII spaces only)."""
    return F.btrim(c, F.lit(SPACES))


def lines(text: Column) -> Column:
    """array<string>: the lines of a text-mode reader; a final break begins no line."""
    return _without_last_empty(F.split(text, LINE_BREAK))


def unicode_lines(text: Column) -> Column:
    """array<string>: the lines in the Unicode sense; a final break begins no line."""
    return _without_last_empty(F.split(text, UNICODE_BREAK))


def _without_last_empty(parts: Column) -> Column:
    last = F.element_at(parts, -1) == ""
    return F.when(last, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def paragraphs(text: Column) -> Column:
    """array<string>: stripped lines that are not blank."""
    # a carriage return as a line feed adds blank lines at most, and one character splits several times faster than a pattern
    broken = F.when(F.contains(text, F.lit("\r")), F.replace(text, F.lit("\r"), F.lit("\n"))).otherwise(text)
    return paragraphs_by_feed(broken)


def paragraphs_by_feed(text: Column) -> Column:
    """paragraphs() of lines that line feeds alone break."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def interleave_blank_lines(paras: Column) -> Column:
    """Paragraphs with a blank line between them and one line feed at the end; no paragraphs give no text."""
    return F.when(F.size(paras) > 0, F.concat(F.array_join(paras, "\n\n"), F.lit("\n"))).otherwise(F.lit(""))


def indent_body(paras: Column) -> Column:
    """Two ideographic spaces before each paragraph but the first."""
    return F.transform(paras, lambda x, i: F.when(i > 0, F.concat(F.lit(INDENT), x)).otherwise(x))


def char_count(text: Column) -> Column:
    """Code points of all stripped lines."""
    return F.aggregate(paragraphs(text), F.lit(0).cast("long"), lambda acc, x: acc + F.char_length(x))


def _pair_quotes(text: Column) -> Column:
    """Each straight double quote by its turn: odd ones open, even ones close."""
    pieces = F.split(text, '"', -1)
    marked = F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.when(i % 2 == 1, F.lit("“")).otherwise(F.lit("”")), x)))
    return F.array_join(marked, "")


def convert_punctuation(text: Column, scope: str = "file") -> Column:
    """ASCII ! ? and double quotes as full-width marks; quotes are paired over the whole text or within each line."""
    wide = F.translate(text, "!?", "！？")
    if scope == "file":
        return _pair_quotes(wide)
    if scope == "line":
        return F.array_join(F.transform(F.split(wide, "\n", -1), _pair_quotes), "\n")
    raise ValueError(f"scope is file or line, not {scope!r}")


def punctuation_stats(text: Column) -> dict[str, Column]:
    """Counts of what convert_punctuation changes; unpaired is 1 if the last quote stays open."""
    count = lambda c: (F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))).cast("long")
    quotes = count('"')
    return {
        "original_quote": quotes,
        "front_quote": F.ceil(quotes / 2).cast("long"),
        "back_quote": F.floor(quotes / 2).cast("long"),
        "original_exclamation": count("!"),
        "original_question": count("?"),
        "unpaired": (quotes % 2).cast("long"),
    }


def _replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def clean_html(c: Column) -> Column:
    """Two forms of <br> as line feeds, other tags dropped, three references decoded one after another; null gives empty text."""
    broken = _replace_all(F.coalesce(c, F.lit("")), [("<br />", "\n"), ("<br>", "\n")])
    return strip(_replace_all(F.regexp_replace(broken, "<[^>]+>", ""), [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]))


def escape_html(c: Column) -> Column:
    return _replace_all(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")])


RESERVED = '/\\:*?"<>|'


def clean_filename(c: Column) -> Column:
    """Characters that file systems reserve become underscores."""
    return F.translate(c, RESERVED, "_" * len(RESERVED))


def sanitize_filename_part(c: Column) -> Column:
    """Reserved characters become spaces; stripped."""
    return strip(F.translate(c, RESERVED, " " * len(RESERVED)))


def file_prefix(name: Column) -> Column:
    """Leading digits of a file name, null without."""
    return F.nullif(F.regexp_extract(name, r"^(\d+)", 1), F.lit(""))


def pad3(n: Column) -> Column:
    """At least three digits; longer numbers keep all of theirs."""
    return F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))


def format_wan(n: Column) -> Column:
    """A count in units of ten thousand with one decimal (binary half-even); null is unset."""
    return F.coalesce(F.concat(F.call_function("format_number", n / F.lit(10000.0), F.lit("0.0")), F.lit("万字")), F.lit(UNSET))


def chinese_date(stamp: Column) -> Column:
    """Y-M-D at the start as a Chinese date; other text keeps its first ten characters; empty is an unknown date."""
    part = lambda k: F.regexp_extract(stamp, r"^(\d{4})-(\d{1,2})-(\d{1,2})", k).cast("int").cast("string")
    dated = F.concat(part(1), F.lit("年"), part(2), F.lit("月"), part(3), F.lit("日"))
    return F.when(F.coalesce(stamp, F.lit("")) == "", F.lit("未知日期")).when(stamp.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), dated).otherwise(F.substring(stamp, 1, 10))


def trim_timestamp(stamp: Column) -> Column:
    return F.substring(F.replace(stamp, F.lit("T"), F.lit(" ")), 1, 19)


def status_text(main: Column, extra: Column, date: Column | None = None) -> Column:
    """N章+M番外（date）, leaving out zero parts; neither is unknown."""
    parts = F.concat_ws("+", F.when(main > 0, F.concat(main.cast("string"), F.lit("章"))), F.when(extra > 0, F.concat(extra.cast("string"), F.lit("番外"))))
    base = F.when(parts == "", F.lit("未知")).otherwise(parts)
    if date is None:
        return base
    return F.when(date.isNull() | (date == "未知日期"), base).otherwise(F.concat(base, F.lit("（"), date, F.lit("）")))


def first_difference(a: Column, b: Column) -> Column:
    """struct<pos, char1, char2>: the first code point that differs, from 1; the shorter side shows (无); null if equal."""
    none = F.lit("(无)")
    differs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    # the position is held in a one-element array, so that it is found once
    found = F.array(F.when(a == b, F.lit(None)).otherwise(F.array_position(differs, True)).cast("int"))
    at = lambda c, pos: F.when(pos <= F.char_length(c), F.substring(c, pos, F.lit(1))).otherwise(none)
    return F.transform(found, lambda pos: F.when(pos.isNotNull(), F.struct(pos.alias("pos"), at(a, pos).alias("char1"), at(b, pos).alias("char2"))))[0]


def page_breaks(c: Column, mark: str = "[newpage]") -> Column:
    """A page-break mark becomes a blank line."""
    return F.replace(c, F.lit(mark), F.lit("\n\n"))


# Media types by file extension.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml"}


def image_media_type(name: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))), F.lit("image/jpeg"))


def distinct_tags(tags: Column) -> Column:
    """Stripped tags without empty ones, each at its first place."""
    return F.array_distinct(F.filter(F.transform(tags, strip), lambda t: t.isNotNull() & (t != "")))


def once(df, **columns: Column):
    """df with columns that are computed a single time, however often later expressions read them.

    The optimizer merges projections and would repeat them; a one-row generator keeps them apart.
    """
    held = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    return df.select("*", held).select(*[c for c in df.columns if c not in columns], "_once.*")
