"""Landed responses, notes, reports and candidate search, by hand."""

from pyspark.sql import functions as F

from quire import api
from quire.operators import index, reports
from quire.sources import files, landed


def test_a_missing_folder_has_no_files(spark, tmp_path):
    assert files.read_chapters(spark, str(tmp_path / "none"), "w").count() == 0
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "001 x.txt").write_text("t")
    some, none = (files.read_chapters(spark, str(tmp_path / d), "w") for d in ("a", "none"))
    assert some.columns == none.columns and some.unionByName(none).count() == 1


def test_illustration_files_are_told_apart_by_content(spark):
    texts = {"a": '\ufeff [{"chapter": 3, "img": "x.png", "desc": "d"}]', "b": "[broken\n007 t\n【插图: y.png】\nz", "c": "", "d": None}
    got = files.illustrations(spark.createDataFrame(list(texts.items()), "k string, text string"), "k").collect()
    assert {(r.k, r.chapter, r.img, tuple(r.desc)) for r in got} == {("a", "003", "x.png", ("d",)), ("b", "007", "y.png", ("z",))}


def test_overviews_with_gaps(spark):
    pages = {"1": '{"error":false,"body":{"title":"","name":"N","user":{"name":"U"},"caption":"<b>c</b>","publishedDate":"p"}}', "2": '{"error":true,"message":"m"}', "3": "no", "4": None}
    got = {r.series_id: r for r in landed.series_overview(spark.createDataFrame(list(pages.items()), "series_id string, json string")).collect()}
    assert (got["1"].ok, got["1"].title, got["1"].author, got["1"].description, got["1"].update_time, got["1"].tags, got["1"].cover) == (True, "N", "U", "c", "p", [], None)
    assert all((got[k].ok, got[k].title, got[k].tags, got[k].cover_url) == (False, "", [], None) for k in "234")


def test_an_image_of_another_chapter_is_not_put_in(spark):
    body = '{"body":{"title":"t","content":"[uploadedimage:1]|[uploadedimage:2]","textEmbeddedImages":{"%s":{"urls":{"original":"http://h/%s.png"}}}}}'
    details = spark.createDataFrame([("w", "1", "n1", body % (1, "a")), ("w", "2", "n2", body % (2, "b")), ("w", "3", "n3", '{"error":true}')], "work_id string, chapter_num string, novel_id string, json string")
    parts = landed.download(details)
    assert {r.file_name: r.content for r in parts["chapters"].collect()} == {"1 t.txt": "\n\n【插图: ch1_up_1.png】\n\n|[uploadedimage:2]", "2 t.txt": "[uploadedimage:1]|\n\n【插图: ch2_up_2.png】\n\n"}
    assert [r.novel_id for r in parts["failed"].collect()] == ["n3"]
    assert {(r.key, r.time, r.desc) for r in parts["metadata"].collect()} == {("001", "未知时间", index.NO_DESCRIPTION), ("002", "未知时间", index.NO_DESCRIPTION)}


def test_reports(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc\nd", "a\nx"), (2, None, "")], "k int, text1 string, text2 string")
    got = {r.k: r.report for r in reports.comparison_text(rows).collect()}
    head = "文件1和文件2之间的差异：\n\n"
    assert got[2] == head + "总共 0 处错误"
    change = "第 1 个错误：\n文件1第 2 行：\nb\n文件2第 2 行：\nx\n第一个不同的字符在位置 1，'b' vs 'x'，这段共有 1 个错误\n\n"
    assert got[1] == head + change + "总共 3 处错误文件1额外的行 3：'c'\n文件1额外的行 4：'d'\n"
    assert "文件1额外的行 5：'c'\n文件1额外的行 6：'d'\n" in {r.k: r.report for r in reports.comparison_text(rows, compat=True).collect()}[1]
    base = [("w", "001", "001 a.txt", "x\ny"), ("w", "002", "002 b.txt", "s"), ("w", "z.txt", "z.txt", "q"), ("w", "010", "010 k.txt", "same")]
    fixed = [("w", "001", "001 a2.txt", "x"), ("w", "002", "002 c.txt", "s"), ("w", "z.txt", "z.txt", "Q"), ("w", "011", "011 n.txt", "new"), ("w", "010", "010 k.txt", "same")]
    schema = "work_id string, chapter_key string, file_name string, text string"
    text = api.diff_layers(spark.createDataFrame(base, schema), spark.createDataFrame(fixed, schema))["report"].first().report
    assert text == (
        "\n1 个配对文件发现内容差异：\n\n===== [001] 001 a.txt  vs  001 a2.txt — 1 处差异 =====\n  校正版删除了 1 段:\n    第 2 段 (标准化独有): y\n"
        "\n1 个文件仅改了文件名（内容一致）:\n  [002] 002 b.txt  ->  002 c.txt\n"
        "\n1 个无前缀文件发现差异:\n\n===== z.txt — 1 处差异 =====\n  第 1 段 第 1 字: 'q' vs 'Q'\n    标准化: q\n    校正版: Q\n"
        "\n仅校正目录存在 1 个文件（新增）:\n  [011] 011 n.txt\n"
        "\n对比完成: 2 篇改动，2 篇未改（其中 1 篇仅改名），0 篇未校正，1 篇新增\n"
    )


def test_notes(spark):
    schema = "w string, key string, msg string, filename string, mtime string, updated_at string"
    old = spark.createDataFrame([("w", "001", "m", "001 a.txt", "t", "1"), ("w", "002 b.txt", "legacy", "002 b.txt", "t", "1"), ("v", "001", "other", "", "", "1")], schema)
    held = spark.createDataFrame([("w", "001 a.txt", "8"), ("w", "003 c.txt", "9")], "w string, file_name string, mtime string")
    new = spark.createDataFrame([("w", "1x.txt", "by name", "2"), ("w", "003", "by number", "2"), ("w", "002 b.txt", "again", "2"), ("w", "001", "n", "2")], "w string, filename string, msg string, updated_at string")
    got = {(r.w, r.key, r.msg, r.filename, r.mtime) for r in api.note_add(old, new, held, "w").collect()}
    assert got == {("w", "1", "by name", "1x.txt", ""), ("w", "003", "by number", "003 c.txt", "9"), ("w", "002", "again", "002 b.txt", ""), ("w", "001", "n", "001 a.txt", "8"), ("v", "001", "other", "", "")}
    names = spark.createDataFrame([("w", "001 any.txt"), ("w", "002 b.txt"), ("w", "009")], "w string, filename string")
    assert [(r.w, r.key) for r in api.note_remove(old, names, "w").collect()] == [("v", "001")]
    assert api.note_list(old, "w").where("w = 'w'").first().text == "[001] 001 a.txt: m\n[002 b.txt] 002 b.txt: legacy"
    assert [r.w for r in api.note_clear(old, names, "w").collect()] == ["v"]


def test_retry_compares_numbers(spark):
    records = spark.createDataFrame([("1", "11"), ("2", "12")], "chapter_num string, novel_id string")
    chapters = spark.createDataFrame([("1",), (None,)], "prefix string")
    assert [r.novel_id for r in api.retry(records, chapters).collect()] == ["12"]


def test_places(spark):
    folders = spark.createDataFrame([("w", 0, "/a/base"), ("w", 1, "/a/fixed")], "work_id string, rank int, folder string")
    got = [r.place for r in landed.search_places(folders, ["", "illustrations"]).orderBy("priority").collect()]
    assert got == ["/a/fixed", "/a/fixed/illustrations", "/a", "/a/illustrations", "/a/base", "/a/base/illustrations"]


def test_style_files(tmp_path):
    from quire.sources import config

    path = tmp_path / "styles.json"
    made = config.load_presets(str(path))
    assert path.exists() and set(made["chapter"]) == {"default", "split_title"} and made["chapter"]["split_title"]["split"] and made["volume"]["default"] == config.VOLUME_STYLE
    assert config.load_presets(str(path)) == made
    path.write_bytes(b"\xff{")
    assert config.load_presets(str(path)) == {"chapter": {}, "volume": {}} == config.load_presets(str(tmp_path / "none" / "x.json"))


def test_import_list_and_clock(spark):
    tasks = spark.createDataFrame([("1", "11"), ("2", "12"), ("x", "13")], "chapter_num string, novel_id string")
    chapters = spark.createDataFrame([("001",)], "prefix string")
    assert [r.novel_id for r in api.import_tasks(tasks, chapters).collect()] == ["12"] and api.import_tasks(tasks, chapters, force=True).count() == 2
    import re

    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d", spark.range(1).select(index.now_iso()).first()[0])
