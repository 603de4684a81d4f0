import json

from quire import api

PAGE = lambda ids: json.dumps({"body": {"seriesContents": [{"id": i, "textCount": 10} for i in ids]}})
DETAIL = lambda title, text: json.dumps({"error": False, "body": {"title": title, "content": text, "createDate": "2020-01-02T03:04:05+09:00"}})


def tables(spark):
    overviews = spark.createDataFrame([("s", json.dumps({"body": {"title": "T", "userName": "A"}})), ("r", "broken")], "work_id string, json string")
    pages = spark.createDataFrame([("s", 0, PAGE(["11", "12", "13"])), ("s", 1, PAGE(["14"])), ("r", 0, PAGE(["21", "22"]))], "work_id string, page_no int, json string")
    details = spark.createDataFrame([("11", DETAIL("a", "x")), ("12", DETAIL("b/c", "y[newpage]z")), ("13", '{"error": true}'), ("21", DETAIL("d", "w")), ("22", DETAIL("e", "v"))], "id string, json string")
    return overviews, pages, details


def test_series(spark):
    done = spark.createDataFrame([("s", "001"), ("r", "9"), ("r", None)], "work_id string, prefix string")
    got = api.series(*tables(spark), done=done)
    assert {(r.work_id, r.n_tasks, r.n_skipped, r.n_done, r.n_failed) for r in got["totals"].collect()} == {("s", 4, 1, 1, 2), ("r", 2, 0, 2, 0)}
    assert {(r.work_id, r.file_name[:4]) for r in got["chapters"].collect()} == {("s", "002 "), ("r", "001 "), ("r", "002 ")}
    assert {(r.chapter_num, r.novel_id) for r in got["failed"].collect()} == {("003", "13"), ("004", "14")}
    info = {r.work_id: r.text for r in got["info"].collect()}
    assert "系列名称: T\n作者: A" in info["s"] and "章节数: 4" in info["s"] and "系列名称: 未知系列" in info["r"]
    again = api.series(*tables(spark), done=done, force=True, start=5)
    assert {r.chapter_num for r in again["records"].collect() if r.work_id == "s"} == {"005", "006"}


def test_selections(spark):
    wanted = spark.createDataFrame([("s", " 2-3 "), ("r", "2-9")], "work_id string, wanted string")
    got = api.series(*tables(spark), selection=wanted)
    assert {(r.work_id, r.pos) for r in api.selected(got["tasks"], wanted).collect()} == {("s", 2), ("s", 3)}
    assert [(r.work_id, r.wanted) for r in api.odd_selections(got["tasks"], wanted).collect()] == [("r", "2-9")]
    assert {(r.work_id, r.chapter_num) for r in got["records"].collect()} == {("s", "002")}
    for text, kept in (("", 4), (None, 4), ("3", 1), ("0", 0), ("3-2", 0), ("x", 0), ("1-4", 4), ("99999999999999999999", 0)):
        one = spark.createDataFrame([("s", text)], "work_id string, wanted string")
        assert api.selected(got["tasks"].where("work_id = 's'"), one).count() == kept, text


def test_novels_and_import_lists(spark):
    _, _, details = tables(spark)
    got = api.novel(spark.createDataFrame([("n", "11"), ("m", "99")], "work_id string, id string"), details)
    assert {(r.work_id, r.n_done, r.n_failed) for r in got["totals"].collect()} == {("n", 1, 0), ("m", 0, 1)}
    tasks = spark.createDataFrame([("c", "1", "11"), ("c", "1", "12"), ("c", "x", "21"), ("c", "2", "22")], "work_id string, chapter_num string, novel_id string")
    got = api.csv(tasks, details, done=spark.createDataFrame([("c", "002")], "work_id string, prefix string"))
    assert {(r.chapter_num, r.novel_id) for r in got["records"].collect()} == {("001", "12")} and got["totals"].first().n_skipped == 1
