import html
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import numerals as N
from quire.functions import text as X
from quire.operators.markup import paragraph_html


def values(spark, rows, *columns, schema="a string, b string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r, None) for r in rows], schema)
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


def test_interleave(spark):
    got = values(spark, ["  a \n\n　b", "", None], X.interleave_blank_lines(X.paragraphs(F.coalesce("a", F.lit("")))))
    assert got == ["a\n\nb\n", "", ""]


def test_lines(spark):
    assert values(spark, ["a\r\nb\rc\n"], X.lines(F.col("a"))) == [["a", "b", "c"]]
    assert values(spark, ["a\x0bb\x85c d\n"], X.unicode_lines(F.col("a"))) == ["a\x0bb\x85c d\n".splitlines()]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)), max_size=12), min_size=1, max_size=30))
def test_strip_and_escape_match_python(spark, texts):
    import html

    got = values(spark, texts, X.strip(F.col("a")), X.escape_html(F.col("a")), X.char_count(F.col("a")))
    for t, (stripped, escaped, n) in zip(texts, got):
        assert stripped == t.strip()
        assert escaped == html.escape(t, quote=True)
        assert n == sum(len(x.strip()) for x in t.replace("\r\n", "\n").replace("\r", "\n").split("\n"))


def test_punctuation(spark):
    assert values(spark, ['"a" "b!'], X.convert_punctuation(F.col("a"))) == ["“a” “b！"]
    assert values(spark, ['"a\nb"'], X.convert_punctuation(F.col("a"), "line"), X.convert_punctuation(F.col("a"))) == [("“a\nb“", "“a\nb”")]
    s = X.punctuation_stats(F.col("a"))
    assert values(spark, ['"a" "b!'], *s.values()) == [(3, 2, 1, 1, 0, 1)]
    with pytest.raises(ValueError):
        X.convert_punctuation(F.col("a"), "page")


def test_markup_and_names(spark):
    assert values(spark, ["a<br />b<br/>c<i>d</i>&amp;lt;", None], X.clean_html(F.col("a"))) == ["a\nbcd<", ""]
    assert values(spark, ["a/b:c"], X.sanitize_filename_part(F.col("a")), X.clean_filename(F.col("a"))) == [("a b c", "a_b_c")]
    assert values(spark, ["043 x.txt", "12abc.txt", "附录.txt"], X.file_prefix(F.col("a"))) == ["043", "12", None]
    assert values(spark, ["a.PNG", "b", "c.tiff"], X.image_media_type(F.col("a"))) == ["image/png", "image/jpeg", "image/jpeg"]


def test_formats(spark):
    n = F.col("a").cast("long")
    assert values(spark, ["2500", "3500", "7500", "14500", "0", None], X.format_wan(n)) == ["0.2万字", "0.3万字", "0.8万字", "1.4万字", "0.0万字", "未填"]
    assert values(spark, ["2026-08-05 20:16:19", "", "foo bar bazqux"], X.chinese_date(F.col("a"))) == ["2026年8月5日", "未知日期", "foo bar ba"]
    assert values(spark, ["7", "1000"], X.pad3(n)) == ["007", "1000"]
    assert values(spark, [("2", "1"), ("0", "3"), ("0", "0")], X.status_text(n, F.col("b").cast("long"))) == ["2章+1番外", "3番外", "未知"]


def test_first_difference(spark):
    got = values(spark, [("abc", "abd"), ("abc", "abcx"), ("abcx", "abc"), ("a", "a")], X.first_difference(F.col("a"), F.col("b")))
    assert [None if g is None else tuple(g) for g in got] == [(3, "c", "d"), (4, "(无)", "x"), (4, "x", "(无)"), None]


def test_int_to_chinese(spark):
    cases = {0: "零", 10: "十", 19: "十九", 43: "四十三", 100: "一百", 101: "一百零一", 110: "一百一十", 1010: "一千零一十", 10005: "一万零五"}
    assert values(spark, [str(k) for k in cases], N.int_to_chinese(F.col("a").cast("long"))) == list(cases.values())
    with pytest.raises(Exception):
        values(spark, ["100000"], N.int_to_chinese(F.col("a").cast("long")))


def test_chinese_to_int(spark):
    cases = {"十": 10, "十九": 19, "一百零三": 103, "两百": 200, "零": None, "2.5": None, "一万": 10000, "一二": None, "三万五千": 35000}
    assert values(spark, list(cases), N.chinese_to_int(F.col("a"))) == list(cases.values())
    assert values(spark, ["一万", "一二"], N.chinese_to_int(F.col("a"), compat=True)) == [100000000, 2]


def test_numerals_round_trip(spark):
    n = spark.range(1, 100000, 37)
    assert n.where(N.chinese_to_int(N.int_to_chinese(F.col("id"))) != F.col("id")).count() == 0


def test_markers(spark):
    yes = {"第一章 x": (1, "chinese"), "第11章": (11, "arabic"), "第二章天使降临我身边？": (2, "chinese"), "番外": (None, "extra"), "番外：x": (None, "extra"), "第2.5章 x": (None, None), "第两百章 x": (200, "chinese"), " 第3节：y ": (3, "arabic")}
    m = N.marker_columns(F.col("a"))
    assert values(spark, list(yes), m["marker"], m["num"], m["style"]) == [(k.strip(), *v) for k, v in yes.items()]
    no = ["第三章内容。", "番外 x", "第一章 " + "x" * 40, "", "  "]
    assert values(spark, no, m["marker"]) == [None] * len(no)
    strict = N.marker_columns(F.col("a"), limit_title=True)["marker"]
    assert values(spark, ["第一章" + "x" * 20, "第一章 " + "x" * 20], strict) == [None, "第一章 " + "x" * 20]


def test_titles(spark):
    cases = {"第一章 x": ("第一章", "x"), "第2.5章 x": ("第2.5章", "x"), "番外：y": ("番外", "y"), "番外 y": ("番外", "y"), "第一章x": (None, "第一章x"), "第两百章 x": (None, "第两百章 x")}
    assert [tuple(r) for r in values(spark, list(cases), N.split_title(F.col("a")))] == list(cases.values())
    cases = {"第一卷 示例": ("第一卷", "示例"), "番外篇 往事": ("番外篇", "往事"), "第一卷": (None, "第一卷"), "山川篇": (None, "山川篇")}
    assert [tuple(r) for r in values(spark, list(cases), N.split_volume_title(F.col("a")))] == list(cases.values())
    assert values(spark, ["第3章 雪棠", "第一章", "番外：x"], N.chapter_name(F.col("a"))) == ["雪棠", "第一章", "番外：x"]


def test_white_space_class_is_pythons(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    assert values(spark, [f"{c}x{c}" for c in spaces], X.strip(F.col("a"))) == ["x"] * len(spaces)
    assert unicodedata.category("　") == "Zs"


def test_paragraphs_end_at_any_line_break(spark):
    texts = ["a\rb\r\nc\n\rd", "\r\r\n\n", "\r\n　x 　\r", "", None, "one"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(X.paragraphs(F.col("t"))).collect()]
    assert got == [["a", "b", "c", "d"], [], ["x"], [], None, ["one"]]


def test_paragraph_html_escapes_each_special_character(spark):
    texts = ["a&b", "<i>", 'say "x"', "it's", "&amp;<", "plain", "", None]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(paragraph_html(F.col("t"))).collect()]
    assert got == [None if t is None else f"<p>{html.escape(t, quote=True)}</p>" for t in texts]
