import pytest

from quire import api
from quire.operators import index, overlay, publish, stats, volumes
from quire.sources.sink import write_files
from pyspark.sql import functions as F


@pytest.fixture()
def layers(spark):
    make = lambda rows: overlay.with_keys(spark.createDataFrame([("w", n, t) for n, t in rows], "work_id string, file_name string, text string"))
    return make([("001 A.txt", "A\nx"), ("002 B.txt", "B\ny"), ("000 书籍信息.txt", "i")]), make([("002 B2.txt", "B2\nz!")])


def test_merge_assemble_diff(spark, layers):
    base, corrected = layers
    ranges = volumes.valid_volumes(spark.createDataFrame([("w", 0, "V", 1, 1)], "work_id string, pos int, name string, start long, end long"))
    # the information page stands first, as it does in a merged book
    assert api.merge(base, corrected, ranges=ranges).first().text == "i\n\n\nV\n\nA\n\nx\n\nB2\n\nz!\n\n"
    parts = api.assemble(base, corrected)
    assert parts["lineage"].first().text == "000 书籍信息.txt <- baseline\n001 A.txt <- baseline\n002 B2.txt <- corrected (was 002 B.txt)"
    assert {r.status: r.n_files for r in api.diff_layers(base, corrected)["summary"].collect()} == {"only_baseline": 2, "modified": 1}
    assert api.compare(base, corrected).count() == 2
    book = api.epub(base, corrected, ranges=ranges, info=spark.createDataFrame([("w", "T", "A")], "work_id string, title string, author string"), modified="2020-01-01T00:00:00Z").first()
    assert book.file_name == "T.epub" and bytes(book.content)[:2] == b"PK"


def test_split_format_punct_retry(spark, layers):
    packed = spark.createDataFrame([("w", "v1.txt", 1, "第一章 a\nx\n第三章 b")], "work_id string, file_name string, file_ord int, text string")
    parts = api.split(packed, name_only=True)
    assert sorted(r.file_name for r in parts["chapters"].collect()) == ["001 a.txt", "002 b.txt"]
    assert parts["volumes"].first().json == '[{"name":"v1","start":1,"end":2}]'
    formatted = {r.file_name: r.text for r in api.format_chapters(layers[1], punct=True).collect()}
    assert formatted == {"002 第一章 B2.txt": "第一章 B2\n\nB2\n\nz！\n"}
    assert api.format_single(layers[0]).where("file_name = '001 A.txt'").first().text == "A\n\nx\n"
    assert api.punct(layers[1]).first().original_exclamation == 1
    records = spark.createDataFrame([("1", "11"), ("9", "19")], "chapter_num string, novel_id string")
    assert [r.novel_id for r in api.retry(records, layers[0]).collect()] == ["19"]


def test_series_page_and_revisions(spark):
    page = spark.range(1).select(publish.series_info_page(F.lit("7"), F.lit("S"), F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("long"), F.lit(2), F.array(F.lit("a"), F.lit("b")), F.lit("d"))).first()[0]
    assert page == "系列ID: 7\n系列名称: S\n作者: 未知作者\n更新时间: 未知时间\n总字数: 0\n章节数: 2\n标签: a、b\n\n简介:\nd"
    old = index.revisions_of(spark.createDataFrame([("w", '{"001 a.txt":{"msg":"m","filename":"001 a.txt","mtime":"1","updated_at":"1"}}'), ("x", "bad")], "work string, json string"), "work")
    notes = spark.createDataFrame([("w", "n", "001 a.txt", "2", "2")], "work string, msg string, filename string, mtime string, updated_at string")
    done = index.set_revisions(old, notes, "work")
    assert index.revisions_json(done, "work").first().json == '{"001":{"msg":"n","filename":"001 a.txt","mtime":"2","updated_at":"2"}}'


def test_named_files(spark, tmp_path):
    target = str(tmp_path / "out")
    write_files(spark.createDataFrame([("001 第一章 a.txt", "x"), ("_source_map.txt", "y")], "file_name string, content string"), target)
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"001 第一章 a.txt": "x", "_source_map.txt": "y"}
    with pytest.raises(Exception):
        write_files(spark.createDataFrame([("../evil", "x")], "file_name string, content string"), target)
    assert len(list((tmp_path / "out").iterdir())) == 2


def chapters(spark, rows):
    return overlay.with_keys(spark.createDataFrame([("w", n, t) for n, t in rows], "work_id string, file_name string, text string"))


def test_merge_renews_the_information_page(spark):
    page = publish.blank_info_page()
    base = chapters(spark, [("000 书籍信息.txt", page), ("001 a.txt", "t\n四个字呀"), ("002 番外 b.txt", "x"), ("_source_map.txt", "no"), ("附录.txt", "end")])
    ranges = volumes.valid_volumes(spark.createDataFrame([("w", 0, "V", 1, 1)], "work_id string, pos int, name string, start long, end long"))
    text = api.merge(base, ranges=ranges, info=True).first().text
    assert text.startswith("书籍信息\n\n未填\n\n作者：未填\n\n连载于：未填\n\n连载状态：2章+1番外\n\n卷/篇数：1\n\n字数：0.0万字") and text.endswith("x\n\nend\n\n") and "no" not in text
    assert api.merge(base).first().text.count("未填") == 6


def test_book_info(spark):
    files = chapters(spark, [("001 a.txt", "t"), ("002 番外 b.txt", "x")])
    assert api.book_info(files).first().text == publish.blank_info_page()
    about = spark.createDataFrame([("w", "T", "A", "Web", "2026-08-05 20:16:19", 12345, "d")], "work_id string, title string, author string, platform string, update_time string, words long, description string")
    row = api.book_info(files, about).first()
    assert row.file_name == "000 书籍信息.txt" and row.text == "书籍信息\n\nT\n\n作者：A\n\n连载平台：Web\n\n连载状态：1章+1番外（2026年8月5日）\n\n字数：1.2万字\n\n简介：\n\nd\n"
    assert api.book_info(files, about.where("false")).first().text == publish.blank_info_page()


def test_a_repeated_prefix_does_not_multiply(spark):
    base, fixed = chapters(spark, [("002 A.txt", "a"), ("002 B.txt", "b"), ("003 C.txt", "c")]), chapters(spark, [("002 C.txt", "x"), ("002 D.txt", "y")])
    done = {(r.chapter_key, r.file_name, r.text, r.replaces) for r in api.assemble(base, fixed)["chapters"].collect()}
    assert done == {("002", "002 D.txt", "y", "002 B.txt"), ("003", "003 C.txt", "c", "003 C.txt")}
    assert api.diff_layers(base, fixed)["chapters"].count() == 2 and api.compare(base, fixed).count() == 1


def test_quotes_pair_within_a_chapter(spark):
    packed = spark.createDataFrame([("w", "v1.txt", 1, '第一章 a\nopen "x\n第二章 b\n"y" z?')], "work_id string, file_name string, file_ord int, text string")
    parts = {r.seq: (r.title, r.body) for r in api.split(packed, punct=True)["chapters"].collect()}
    assert parts == {1: ("第一章 a", "open “x"), 2: ("第二章 b", "“y” z？")}


def test_pending_filled_ranked_and_format_stats(spark):
    tasks, done = spark.createDataFrame([("1",), ("2",)], "k string"), spark.createDataFrame([("1",)], "k string")
    assert [r.k for r in overlay.pending(tasks, done, "k").collect()] == ["2"] and overlay.pending(tasks, done, "k", force=True).count() == 2
    titles = spark.createDataFrame([("w", True), ("w", False)], "work_id string, is_extra boolean")
    skipped = spark.createDataFrame([("w",), ("v",)], "work_id string")
    assert {tuple(r) for r in stats.format_stats(titles, skipped).collect()} == {("w", 1, 1, 1), ("v", 0, 0, 1)}
