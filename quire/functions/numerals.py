"""Chinese numerals and the titles that carry them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import SPACE, strip

# Digits, units and the letters of numerals as they stand in titles.
DIGITS = "零一二三四五六七八九"
UNITS = ["", "十", "百", "千", "万"]
NUMERAL = "一二三四五六七八九十百千万零两0-9."
TITLE_NUMERAL = "0-9一二三四五六七八九十百千万零点."
CHAPTER_UNITS = "章话节回"
EXTRA = "番外"
MARKER = rf"^第([{NUMERAL}]+)([{CHAPTER_UNITS}])"
MAX_MARKER = 40


def int_to_chinese(n: Column) -> Column:
    """0 .. 99999 as a numeral, 10-19 without a leading one; larger numbers have no unit and raise."""
    text = n.cast("string")
    size = F.char_length(text)
    units = F.array(*[F.lit(u) for u in UNITS])

    def spelled(c: Column, i: Column) -> Column:
        digit = F.substring(F.lit(DIGITS), c.cast("int") + 1, F.lit(1))
        return F.when(c == "0", F.lit("零")).otherwise(F.concat(digit, F.element_at(units, (size - i).cast("int"))))

    whole = F.array_join(F.transform(F.split(text, ""), spelled), "")
    short = F.regexp_replace(F.regexp_replace(whole, "零+", "零"), "零$", "")
    return F.when(n == 0, F.lit("零")).otherwise(F.regexp_replace(short, "^一十", "十"))


def chinese_to_int(s: Column, compat: bool = False) -> Column:
    """The value of a numeral; null for other characters and for zero.

    compat reproduces two oddities: 万 multiplies twice, and of adjacent digits the last counts;
    otherwise 万 multiplies what stands before it once and adjacent digits are no numeral.
    """
    values = F.create_map(*[F.lit(x) for kv in [*((c, k) for k, c in enumerate(DIGITS)), ("两", 2), ("十", 10), ("百", 100), ("千", 1000), ("万", 10000)] for x in kv])
    long = lambda x: F.lit(x).cast("long")
    start = F.struct(long(0).alias("total"), long(0).alias("section"), long(0).alias("digit"), F.lit(True).alias("ok"), F.lit(False).alias("after_digit"))

    def step(acc: Column, c: Column) -> Column:
        v = F.try_element_at(values, c).cast("long")
        is_digit = (v < 10) & (c != "十")
        ones = F.greatest(acc["digit"], long(1))  # a unit without a digit before it counts once
        if compat:
            wan = (acc["total"] + acc["section"] + ones * v) * v
        else:
            wan = F.greatest(acc["total"] + acc["section"] + acc["digit"], long(1)) * v
        total = F.when(v == 10000, wan).otherwise(acc["total"])
        section = F.when(is_digit, acc["section"]).when(v == 10000, long(0)).otherwise(acc["section"] + ones * v)
        digit = F.when(is_digit, v).otherwise(long(0))
        clash = F.lit(False) if compat else is_digit & acc["after_digit"]
        ok = acc["ok"] & v.isNotNull() & ~F.coalesce(clash, F.lit(False))
        return F.struct(total.alias("total"), section.alias("section"), digit.alias("digit"), ok.alias("ok"), F.coalesce(is_digit & (c != "零"), F.lit(False)).alias("after_digit"))

    done = F.aggregate(F.split(s, ""), start, step, lambda acc: F.when(acc["ok"], acc["total"] + acc["section"] + acc["digit"]))
    return F.when(done > 0, done)


def marker_columns(line: Column, limit_title: bool = False, space: str = SPACE) -> dict[str, Column]:
    """What a line is as a chapter marker: marker (its stripped text), num and style (arabic, chinese, extra); all null for other lines.

    A number that cannot be read leaves num and style null. A marker whose number is not followed by white
    space, a colon or the end must not contain a full stop, nor with limit_title exceed 20 characters. space is the
    white space that is meant, as a class.
    """
    s = strip(line)
    fits = (s != "") & (F.char_length(s) <= MAX_MARKER)
    rest = F.regexp_replace(s, MARKER, "")
    glued = (rest != "") & ~rest.rlike(rf"^[{space}：:]")
    prose = glued & (F.contains(s, F.lit("。")) | (F.lit(limit_title) & (F.char_length(s) > 20)))
    numbered = fits & s.rlike(MARKER) & ~prose
    # `.` must not cross line feeds only
    extra = fits & s.rlike(rf"(?d)^{EXTRA}([：:].*)?$")
    num_text = F.regexp_extract(s, MARKER, 1)
    arabic = num_text.rlike(r"^\d+$")
    num = F.when(arabic, F.expr("null").cast("long")).otherwise(chinese_to_int(num_text))
    num = F.when(numbered, F.when(arabic, num_text.try_cast("long")).otherwise(num))
    style = F.when(numbered & arabic, F.lit("arabic")).when(numbered & num.isNotNull(), F.lit("chinese")).when(~numbered & extra, F.lit("extra"))
    return {"marker": F.when(numbered | extra, s), "num": num, "style": style}


def renumbered(marker: Column, num: Column, new_num: Column, style: Column) -> Column:
    """A marker with a new number in the given style; a space is put where the title was glued to the number."""
    unit = F.regexp_extract(marker, MARKER, 2)
    rest = F.regexp_replace(F.regexp_replace(marker, MARKER, ""), rf"[{SPACE}]+\z", "")
    glued = (rest != "") & ~rest.rlike(rf"^[{SPACE}：:]")
    shown = F.when(style == "chinese", int_to_chinese(new_num)).otherwise(new_num.cast("string"))
    return F.when(num.isNull() | new_num.isNull(), marker).otherwise(F.concat(F.lit("第"), shown, unit, F.when(glued, F.lit(" ")).otherwise(F.lit("")), rest))


def split_title(title: Column) -> Column:
    """struct<num, name>: 番外 or 第N章 apart from the name; num null and the whole title as name otherwise."""
    # `.` must not cross line feeds only, so patterns are in UNIX_LINES mode
    extra = rf"(?d)^{EXTRA}(?:[：:][{SPACE}]*|[{SPACE}]+)(.+)$"
    chapter = rf"(?d)^(第[{TITLE_NUMERAL}]+[章话回节])[{SPACE}]+(.+)$"
    pick = lambda num, name: F.struct(num.alias("num"), name.alias("name"))
    return (
        F.when(title.rlike(extra), pick(F.lit(EXTRA), strip(F.regexp_extract(title, extra, 1))))
        .when(title.rlike(chapter), pick(F.regexp_extract(title, chapter, 1), strip(F.regexp_extract(title, chapter, 2))))
        .otherwise(pick(F.lit(None).cast("string"), title))
    )


def split_volume_title(name: Column) -> Column:
    """struct<num, name>: 第N卷, 第N部 or 番外篇 apart from the name, if there is one."""
    pattern = rf"(?d)^(第[{NUMERAL}]+[卷部篇集]|{EXTRA}(?:篇)?)[{SPACE}]*(.*)$"
    rest = strip(F.regexp_extract(name, pattern, 2))
    split = name.rlike(pattern) & (rest != "")
    return F.when(split, F.struct(strip(F.regexp_extract(name, pattern, 1)).alias("num"), rest.alias("name"))).otherwise(F.struct(F.lit(None).cast("string").alias("num"), name.alias("name")))


def chapter_name(title: Column) -> Column:
    """The title without its number; a title that is only a number stays."""
    s = strip(title)
    name = strip(F.regexp_replace(s, rf"^第[{NUMERAL}]+[{CHAPTER_UNITS}][{SPACE}]*[：:]?[{SPACE}]*", ""))
    return F.when(name == "", s).otherwise(name)


def title_of_file(name: Column) -> Column:
    """The title that a chapter's file name carries: without leading digits and .txt."""
    return strip(F.regexp_replace(F.regexp_replace(name, r"^\d+[ ]*", ""), r"(?i)\.txt$", ""))
