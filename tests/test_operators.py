import io
import xml.etree.ElementTree as ET
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.functions.text import paragraphs
from quire.operators import diff, index, markup, overlay, publish, segment, stats, volumes
from quire.plans.oracles import ORACLE_SQL
from quire.plans.queries import QUERIES
from quire.sources import config, files


def chapters(spark, rows):
    return spark.createDataFrame([("w", k, n, t) for k, n, t in rows], "work_id string, chapter_key string, file_name string, text string")


def test_diff_and_assemble(spark):
    base = chapters(spark, [("001", "001 A.txt", "x"), ("002", "002 B.txt", "p\nq\nr"), ("附录.txt", "附录.txt", None)])
    corrected = chapters(spark, [("002", "002 B2.txt", "p\nQ"), ("003", "003 C.txt", "z")])
    compared = diff.compare(base, corrected)
    assert {r.chapter_key: (r.status, r.n_diffs) for r in compared.collect()} == {"001": ("only_baseline", 1), "002": ("modified", 2), "003": ("only_corrected", 1), "附录.txt": ("only_baseline", 0)}
    rows = {(r.line_no, r.kind, r.pos, r.char1, r.char2, r.compat_line_no) for r in diff.paragraph_diffs(compared).collect()}
    assert rows == {(2, "changed", 1, "q", "Q", 2), (3, "only_in_1", None, None, None, 5)}
    done = overlay.assemble(base, corrected)
    assert tuple(overlay.assemble_summary(done).first()) == (4, 2, 2, 1)
    assert tuple(overlay.assemble_summary(done.where("false")).first()) == (0, 0, 0, 0)
    preview = diff.preview(diff.paragraph_diffs(compared), 1).collect()
    assert [(r.line_no, r.remaining) for r in preview] == [(2, 1)]


def test_overlay_last_layer_wins_and_loses_no_key(spark):
    a = chapters(spark, [("1", "1 a.txt", "a"), ("2", "2 a.txt", "a"), ("2", "2 b.txt", "b")])
    b = chapters(spark, [("2", "2 c.txt", "c"), ("3", "3 c.txt", None)])
    got = {r.chapter_key: r.file_name for r in overlay.overlay(a, b).collect()}
    assert got == {"1": "1 a.txt", "2": "2 c.txt", "3": "3 c.txt"}
    assert {r.chapter_key: r.file_name for r in overlay.unique_prefixes(a).collect()} == {"1": "1 a.txt", "2": "2 b.txt"}


def test_segments_and_renumbering(spark):
    text = "前言\n第二十章 a\nx\n第十九章b\n番外：c\ny\n第二十章 d"
    f = spark.createDataFrame([("w", "v1.txt", 1, text), ("w", "v2.txt", 2, "no marker"), ("w", "v3.txt", 3, "第5章 e\nz")], "work_id string, file_name string, file_ord int, text string")
    lines = segment.marked_lines(f)
    segs = segment.renumber(segment.segments(lines))
    got = [(r.title, r.fixed, r.body) for r in segs.orderBy("file_ord", "seg_no").collect()]
    assert got == [("第二十章 a", False, "x"), ("第二十一章 b", True, ""), ("番外：c", False, "y"), ("第二十二章 d", True, ""), ("第5章 e", False, "z")]
    seqs = segment.sequenced(segs)
    assert [r.seq for r in seqs.orderBy("file_ord", "seg_no").collect()] == [1, 2, 3, 4, 5]
    assert {(r.name, r.start, r.end) for r in segment.volume_ranges(seqs).collect()} == {("v1", 1, 4), ("v3", 5, 5)}
    assert tuple(segment.split_stats(segs, lines).first()) == ("w", 5, 2, 2)
    names = [r.file_name for r in segment.chapter_files(seqs, name_only=True).orderBy("seq").collect()]
    assert names == ["001 a.txt", "002 b.txt", "003 番外：c.txt", "004 d.txt", "005 e.txt"]


def test_display_titles(spark):
    names = ["043 第43章 某某.txt", "044 番外：x.txt", "045 y.txt", "0 info.txt", "附录.txt"]
    f = overlay.with_keys(spark.createDataFrame([("w", n) for n in names], "work_id string, file_name string"))
    got = {r.file_name: r.new_name for r in segment.display_titles(f).collect()}
    assert got == {names[0]: "043 第一章 某某.txt", names[1]: "044 番外：x.txt", names[2]: "045 第二章 y.txt"}


def test_names_of_a_number_alone(spark):
    names = ["043 a.txt", "0440.txt", "045b.txt", "046 c\rd.txt", "0.txt", "附录.txt"]
    f = overlay.with_keys(spark.createDataFrame([("w", n) for n in names], "work_id string, file_name string"))
    assert {r.file_name: (r.number, r.display) for r in segment.display_titles(f, untitled=True).collect()} == {names[0]: (1, "第一章 a"), names[2]: (2, "第二章 "), names[3]: (3, "第三章 c\rd"), names[1]: (4, "第四章 ")}
    assert {r.file_name for r in segment.display_titles(f).collect()} == {names[0], names[3]}


def test_main_extra_numbering_keeps_numbers_without_titles(spark, tmp_path):
    texts = {19: "4763047826333361 of", 20: "x", 21: "a b", 38: "57 tail"}
    spark.createDataFrame([(k, t, "en") for k, t in texts.items()], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, kind, number, display FROM ({ORACLE_SQL['main_extra_numbering']})").fetchall()}
    got = {r.doc_id: (r.kind, r.number, r.display) for r in QUERIES["main_extra_numbering"](spark, str(tmp_path)).collect()}
    assert got == want and got[19] == ("main", 1, "第一章 ")


def both_ways(spark, folder, name, texts):
    """The rows of a query and of its SQL over documents (doc_id, text), by doc_id."""
    spark.createDataFrame([(k, t, "en") for k, t in texts.items()], "doc_id long, text string, lang string").write.parquet(str(folder / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    rows = QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    return {r[0]: tuple(r[1:]) for r in rows.collect()}, {r[0]: r[1:] for r in want}


def test_first_line_title_of_blank_and_odd_texts(spark, tmp_path):
    texts = {0: "", 1: " \n　", 2: "", 4: "a\rb", 5: "T5\nT5\nz", 6: "番外：a\x85b\nx", 8: "\r\n", 9: "番外：y\rz", 10: "第三章　x。", 11: "第三章 x。\n第三章 x。", 13: None, 14: "\n番外\n"}
    got, want = both_ways(spark, tmp_path, "first_line_title", texts)
    assert got == want and not {0, 8, 13} & set(got)
    assert got[2] == ("T2", False, 1) and got[5] == ("T5", False, 3) and got[6] == ("番外：a\x85b", True, 1) and got[10] == ("T10", False, 1)


def test_resolved_titles_keep_every_chapter(spark):
    texts = {"a": "", "b": "b\nb\rz", "c": "番外：a\x85b\rx", "d": "第三章　x。\ny"}
    f = spark.createDataFrame(list(texts.items()), "file_title string, text string")
    got = {r.file_title: (r.display_title, r.skip_first, r.fragments) for r in publish.resolved_titles(f).collect()}
    assert got == {"a": ("a", False, []), "b": ("b", False, ["<p>z</p>"]), "c": ("番外：a\x85b", True, ["<p>x</p>"]), "d": ("第三章　x。", True, ["<p>y</p>"])}


def test_word_count_wan_of_blank_texts(spark, tmp_path):
    texts = {0: "", 1: " \n　\r\n", 2: None, 3: "x", 4: "y" * 2500, 5: "\x1c"}
    got, want = both_ways(spark, tmp_path, "word_count_wan", texts)
    assert got == want == {0: (None, None), 1: (None, None), 2: (None, None), 3: (1, "0.0万字"), 4: (2500, "0.2万字"), 5: (None, None)}


def test_volumes_and_spine(spark):
    cfg = spark.createDataFrame([("w", '[{"name":"b","start":3},{"name":"a","start":"1","end":2},{"start":1},{"name":"x","start":2,"end":1},{"name":"e","start":90,"end":95}]')], "work_id string, json string")
    vols = volumes.valid_volumes(files.volumes_of(cfg))
    assert [(r.name, r.start, r.end, r.vol_no) for r in vols.orderBy("vol_no").collect()] == [("a", 1, 2, 1), ("b", 3, 3, 2), ("e", 90, 95, 3)]
    ch = spark.createDataFrame([("w", f"{k:03d}", k) for k in (1, 2, 3, 4)] + [("w", "附录.txt", None)], "work_id string, chapter_key string, ord int")
    items = volumes.nested(volumes.spine(ch, vols)).orderBy("play_order").collect()
    assert [(r.kind, r.title, r.parent) for r in items] == [("vol", "a", None), ("chap", "001", 1), ("chap", "002", 1), ("vol", "b", None), ("chap", "003", 4), ("chap", "004", None), ("chap", "附录.txt", None)]
    assert [r.play_order for r in items] == list(range(1, 8))


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    once = index.upsert(old, new, ["k"], F.col("v"))
    twice = index.upsert(once, new, ["k"], F.col("v"))
    want = {(1, "a"), (2, "d"), (3, "e")}
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()} == want
    assert {tuple(r) for r in index.remove(once, spark.createDataFrame([(1,)], "k int"), ["k"]).collect()} == {(2, "d"), (3, "e")}


def test_metadata_json_and_summary(spark):
    m = spark.createDataFrame([("w", 1000, "t2", "x", 5, ""), ("w", 2, "t1", "x", 3, "d")], "work string, chapter_num int, title string, time string, word_count long, desc string")
    rows = index.metadata_rows(m).withColumn("work", F.lit("w"))
    assert index.summary(rows, "work").first().summary == "002 t1 x 字数: 3\nd\n\n1000 t2 x 字数: 5\n（暂无简介）\n\n"
    held = index.metadata_json(rows, "work")
    assert held.select(index.from_metadata_json(F.col("json"))["002"]["title"]).first()[0] == "t1"
    assert spark.sql("select 'no json' as j").select(F.size(index.from_metadata_json(F.col("j")))).first()[0] == 0


def test_chapter_selection():
    assert index.chapter_selection("", 5) == [1, 2, 3, 4, 5]
    assert index.chapter_selection("2", 5) == [2]
    assert index.chapter_selection("2 - 4", 5) == [2, 3, 4]
    for bad in ("4-2", "0", "1-6", "a"):
        with pytest.raises(ValueError):
            index.chapter_selection(bad, 5)


def test_info_pages(spark):
    page = "书籍信息\n\n名\n\n连载状态：1章（D）\n\n字数：x\n\n简介：\n\n一\n\n二"
    df = spark.createDataFrame([(page,), ("no counts",)], "page string")
    done = [r[0] for r in df.select(publish.refresh_info(F.col("page"), F.lit(12345), F.lit(2), F.lit(1), F.lit(2))).collect()]
    assert done[0] == "书籍信息\n\n名\n\n连载状态：2章+1番外（D）\n卷/篇数：2\n\n字数：1.2万字\n\n简介：\n\n一\n\n二"
    assert done[1] == "no counts"
    again = spark.createDataFrame([(done[0],)], "page string").select(publish.refresh_info(F.col("page"), F.lit(12345), F.lit(2), F.lit(1), F.lit(0))).first()[0]
    assert "卷/篇数" not in again
    info = files.book_info(spark.createDataFrame([(1, done[0])], "k int, text string"), "k").first()
    assert (info.title, info.status, info.vol_count, info.word_count, info.description) == ("名", "2章+1番外（D）", "2", "1.2万字", "一\n二")
    assert publish.blank_info_page().startswith("书籍信息\n\n未填\n")


def test_series_info(spark):
    text = "系列ID: 7\n系列名称: S: T\n作者： A\n总字数: 1,234 字\n章节数: x\n标签: a、b, ,c\n\n简介:\n l1 \n\nl2: z"
    got = files.series_info(spark.createDataFrame([(1, text), (2, "")], "k int, text string"), "k").orderBy("k").collect()
    assert tuple(got[0]) == (1, "S: T", "A", "", 1234, 0, ["a", "b", "c"], "l1\n\nl2: z")
    assert tuple(got[1]) == (2, "未填", "未填", "", 0, 0, [], "未填")


def test_illustrations(spark):
    text = "﻿【插图: ch041_a.jpg】\nd1\n002\n【插图: b.png】\nd2\n"
    df = spark.createDataFrame([(1, text)], "k int, text string")
    rows = files.illustrations_from_text(df, "k").orderBy("pos").collect()
    assert [(r.chapter, r.img, r.desc) for r in rows] == [("041", "ch041_a.jpg", ["d1"]), ("002", "b.png", ["d2"])]
    assert [(r.chapter, r.img) for r in files.illustrations_from_text(df, "k", compat=True).collect()] == [("002", "b.png")]
    js = '[{"chapter": 3, "img": "x.png", "desc": "a\\n\\nb"}, {"img": "ch9.png"}, {"chapter": "q", "img": "ch9.png"}, {"chapter": 1}]'
    rows = files.illustrations_from_json(spark.createDataFrame([(1, js)], "k int, text string"), "k").orderBy("pos").collect()
    assert [(r.chapter, r.img, r.desc) for r in rows] == [("003", "x.png", ["a", "b"]), ("009", "ch9.png", [])]


def test_image_lookup_and_html(spark):
    paras = spark.createDataFrame([("1", 0, "a【插图: x.png】b"), ("1", 1, "【插图：gone.png】")], "k string, line_no int, text string")
    images = spark.createDataFrame([("x.png", "/b/x.png", 2), ("x.png", "/a/x.png", 1)], "img string, path string, priority int")
    assert {(r.img, r.path) for r in markup.found_images(paras, images).collect()} == {("x.png", "/a/x.png"), ("gone.png", None)}
    body = spark.createDataFrame([("1", ["<p>a</p>"])], "k string, fragments array<string>")
    illus = spark.createDataFrame([("1", 1, "x.png", ["<d>"])], "k string, pos int, img string, desc array<string>")
    got = markup.with_illustrations(body, illus, ["k"]).first().fragments
    assert got == ["<p>a</p>", '<div class="illustration"><img src="img/x.png" alt="插图"/><div class="illustration-desc">&lt;d&gt;</div></div>']


def test_merge_text(spark):
    ch = spark.createDataFrame([("w", "001", 1, "T\n\nx\n"), ("w", "000", 0, "i\nj")], "work_id string, chapter_key string, ord int, text string")
    heads = spark.createDataFrame([("w", "001", "V")], "work_id string, chapter_key string, volume string")
    assert publish.merge_text(ch, heads).first().text == "i\n\nj\n\n\nV\n\nT\n\nx\n\n"
    assert publish.merge_text(ch, heads, indent=True).first().text == "i\n\nj\n\n\nV\n\nT\n\n　　x\n\n"
    std = spark.createDataFrame([("t", "a\nb")], "title string, text string")
    assert std.select(publish.chapter_text(F.col("title"), paragraphs(F.col("text")))).first()[0] == "t\n\na\n\nb\n"


def test_archive_is_an_epub(spark):
    pages = spark.createDataFrame([("x", "vol_00001.xhtml", "vol", "V & W", 1, 1, "<html/>"), ("x", "chap_00002.xhtml", "chap", "a", 1, 2, "<html/>"), ("x", "chap_00003.xhtml", "chap", "b", None, 3, "<html/>")], "work_id string, page_name string, kind string, title string, vol_no int, play_order int, page_html string")
    info = spark.createDataFrame([("x", "T <1>", "A")], "work_id string, title string, author string")
    css = publish.style_sheet(config.CHAPTER_STYLE | {"color": "url(x)"}, config.VOLUME_STYLE)
    made, again = (bytes(publish.books(pages, info, css, "2020-01-01T00:00:00Z").first().content) for _ in "ab")
    assert made == again
    z = zipfile.ZipFile(io.BytesIO(made))
    assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    for name in z.namelist():
        if name.endswith((".opf", ".ncx", ".xhtml", ".xml")):
            ET.fromstring(z.read(name))
    ncx = ET.fromstring(z.read("OEBPS/toc.ncx"))
    orders = [int(p.get("playOrder")) for p in ncx.iter() if p.tag.endswith("navPoint")]
    assert orders == [1, 2, 3] and "url(" not in css


def test_styles():
    both = config.parse_styles('{"chapter": {"a": {"align": "left"}, "b": {"align": "right"}, "c": 1}}')
    assert list(both["chapter"]) == ["a"] and both["volume"] == {}
    assert list(config.parse_styles('{"flat": {}}')["chapter"]) == ["flat"]
    assert config.parse_styles("nope") == {"chapter": {}, "volume": {}}
    assert config.resolve_style(both["chapter"], "a", config.CHAPTER_STYLE, size="2em")["size"] == "2em"
    with pytest.raises(KeyError):
        config.resolve_style(both["chapter"], "z", config.CHAPTER_STYLE)
    assert [config.image_quality(q) for q in (None, 0, 1, 100, 101)] == [None, None, 1, 100, None]


def test_stats(spark):
    f = spark.createDataFrame([("000 info.txt",), ("001 番外.txt",), ("002 x.txt",), ("series_1.txt",)], "file_name string")
    assert tuple(stats.main_and_extra(f).first()) == (1, 1)
    assert spark.createDataFrame([("1.9",), ("x",), (None,)], "v string").select(stats.numeric_total(F.col("v"))).first()[0] == 1


def test_landed_pages(spark):
    pages = spark.createDataFrame([("w", 0, '{"body":{"seriesContents":[{"id":"1","textCount":5},{"id":"2","wordCount":7}]}}'), ("w", 1, '{"body":{"page":{"seriesContents":[{"id":"3"}]}}}'), ("w", 2, "bad")], "work_id string, page_no int, json string")
    assert [(r.id, r.words) for r in files.listing_rows(pages).orderBy("page_no", "pos").collect()] == [("1", 5), ("2", 7), ("3", 0)]
    landed = spark.createDataFrame([("1", '{"body":{"title":"t","content":"abc","createDate":"2020-01-02T03:04:05+00:00"}}'), ("2", '{"error":true}')], "id string, json string")
    got = files.chapter_details(landed).orderBy("id").collect()
    assert (got[0].ok, got[0].time, got[0].word_count, got[1].ok) == (True, "2020-01-02 03:04:05", 3, False)


def test_folder_and_csv_sources(spark, tmp_path):
    d = tmp_path / "chapters"
    d.mkdir()
    (d / "001 第一章 x+y.txt").write_text("a\r\nb", encoding="utf-8")
    (d / "附录.TXT").write_text("c", encoding="utf-8")
    (d / "note.md").write_text("no")
    got = {r.file_name: (r.chapter_key, r.text) for r in files.read_chapters(spark, str(d), "w").collect()}
    assert got == {"001 第一章 x+y.txt": ("001", "a\r\nb"), "附录.TXT": ("附录.TXT", "c")}
    (tmp_path / "records.csv").write_text("001,11\nbad\n002,12,extra\nx,13\n")
    recs = files.read_records(spark, str(tmp_path / "records.csv"))
    assert {tuple(r) for r in recs.collect()} == {("001", "11"), ("x", "13")}
    assert [tuple(r) for r in index.record_rows(recs).collect()] == [("001", "11")]
    (tmp_path / "catalog.csv").write_text("1,a\n1,b\n2,c\n")
    assert {tuple(r) for r in files.read_catalog(spark, str(tmp_path / "catalog.csv")).collect()} == {("1", "b"), ("2", "c")}


def test_streaming_index(spark, tmp_path):
    from quire.streaming.upserts import current, keep_index, versions

    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "k int, v string, at int"
    for k, rows in enumerate(([(1, "a", 1), (2, "b", 1)], [(2, "c", 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        keep_index(spark.readStream.schema(schema).parquet(src), out, ck, ["k"], "at").awaitTermination()
        assert len(versions(spark, out)) == k + 1
    assert {(r.k, r.v) for r in current(spark, out, schema, ["k"]).collect()} == {(1, "a"), (2, "c")}
