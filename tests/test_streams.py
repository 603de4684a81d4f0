import json
import random

import pytest

from quire.sources import paging
from quire.sources.files import listing_rows
from quire.streaming.resume import keep_tasks, states, tasks

EVENT = "work_id string, chapter_key string, kind string, at long"


def brute(batches, attempts=3):
    """(tasks, {key: (done, failures)}) of lists of events."""
    held, out = {}, []
    for batch in batches:
        rank = {"listed": 0, "failed": 1, "done": 2}
        for w, c, kind, at in sorted((e for e in batch if e[2] in rank and e[0] is not None), key=lambda e: (-(2**62) if e[3] is None else e[3], rank[e[2]])):
            s = held.setdefault((w, c), [False, 0, False])
            if s[0] or s[1] >= attempts:
                continue
            if kind == "done":
                s[0] = True
            elif kind == "failed":
                s[1] += 1
                out.append((w, c, min(s[1] + 1, attempts), "fetch" if s[1] < attempts else "given_up"))
            elif not s[2]:
                out.append((w, c, 1, "fetch"))
            s[2] = True
    return sorted(out), {k: (d, f) for k, (d, f, _) in held.items()}


def test_tasks_over_restarts(spark, tmp_path):
    r, batches = random.Random(2), []
    for n in range(4):
        batches.append([(r.choice(["w", "v"]), f"{r.randrange(6):03d}", r.choice(["listed", "listed", "failed", "done", "odd"]), n * 100 + k) for k in range(12)])
        batches[-1] += [("w", "700", "listed", None), (None, "1", "listed", 1)]
        spark.createDataFrame(batches[-1], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        keep_tasks(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        want, _ = brute(batches)
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want
    _, held = brute(batches)
    got = {(s.work_id, s.chapter_key): (s.done, s.failures) for s in states(spark.createDataFrame(sum(batches, []), EVENT)).collect()}
    assert got == held


def test_finished_chapters_are_skipped_and_failed_ones_come_again(spark, tmp_path):
    land = lambda rows: spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: keep_tasks(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    land([("w", "001", "listed", 1), ("w", "002", "listed", 1)])
    run()
    land([("w", "001", "done", 2), ("w", "002", "failed", 2)])
    run()
    land([("w", "001", "listed", 3), ("w", "002", "listed", 3), ("w", "003", "listed", 3)])
    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("w", "001", 1, "fetch"), ("w", "002", 1, "fetch"), ("w", "002", 2, "fetch"), ("w", "003", 1, "fetch")]


def page(first, n, shape=0, order=True):
    items = [{"id": str(k), "textCount": k * 10, **({"order": k + 1} if order else {})} for k in range(first, first + n)]
    return json.dumps({"body": {"seriesContents": items} if shape == 0 else {"page": {"seriesContents": items}}})


def test_cursors():
    assert paging.next_cursor(0, page(0, 30)) == 30 and paging.next_cursor(30, page(40, 30)) == 70
    assert paging.next_cursor(30, page(0, 30, order=False)) == 60
    for last in (page(0, 29), page(0, 0), "{}", "no json", "[1]", '{"body": null}', page(0, 30).replace('"order": 30', '"order": 0')):
        assert paging.next_cursor(60 if last.count("order") != 30 else 0, last) in (paging.END, 30)
    assert paging.next_cursor(90, page(0, 30)) == paging.END


def test_three_restarts_give_each_page_once(spark, tmp_path):
    pages, out, ck = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "ck")
    pages.mkdir()

    def land(work, cursor, text):
        (pages / paging.page_name(work, cursor)).write_text(text)

    def run():
        paging.stream_pages(spark, str(pages), ["a/b", "c", "never"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.work_id, r.page_no, r.cursor) for r in spark.read.schema("work_id string, page_no long, cursor long, json string").parquet(out).collect())

    land("a/b", 0, page(0, 30))
    land("a/b", 60, page(60, 5))
    land("c", 0, page(0, 30, shape=1, order=False))
    assert run() == [("a/b", 0, 0), ("c", 0, 0)]
    assert run() == [("a/b", 0, 0), ("c", 0, 0)]
    land("a/b", 30, page(30, 30))
    land("c", 30, "broken")
    land("c", 60, page(60, 3))
    want = [("a/b", 0, 0), ("a/b", 1, 30), ("a/b", 2, 60), ("c", 0, 0), ("c", 1, 30)]
    assert run() == want and run() == want
    rows = listing_rows(spark.read.parquet(out)).collect()
    assert sorted(int(r.id) for r in rows if r.work_id == "a/b") == list(range(65)) and len(rows) == 95


def test_many_pages_are_few_tasks(tmp_path):
    for work, n in (("a", 300), ("b", 7)):
        for k in range(n):
            (tmp_path / paging.page_name(work, 30 * k)).write_text(page(30 * k, 30 if k + 1 < n else 5))
    reader = paging.ListingPages({"path": str(tmp_path), "works": '["a", "b", "none"]'}).streamReader(None)
    end = reader.latestOffset()
    assert end == {"a": 300, "b": 7}
    runs = reader.partitions({"a": 20}, end)
    assert len(runs) == 5
    got = [row[:3] for run in runs for row in reader.read(run)]
    assert got == [("a", k, 30 * k) for k in range(20, 300)] + [("b", k, 30 * k) for k in range(7)]
    (tmp_path / paging.page_name("a", 600)).unlink()
    with pytest.raises(FileNotFoundError):
        list(reader.read(runs[0]))


def test_too_many_works(spark):
    with pytest.raises(ValueError):
        paging.ListingPages({"path": "x", "works": json.dumps([str(k) for k in range(paging.MAX_WORKS + 1)])}).streamReader(None)
    assert tasks


def test_sink_by_uri_and_after_a_death(spark, tmp_path, monkeypatch):
    from quire.sources import sink

    files = spark.createDataFrame([(f"{k} x.txt", f"text {k}") for k in range(6)], "file_name string, content string")
    out = tmp_path / "out"
    sink.write_files(files, f"file://{out}")
    assert {p.name: p.read_text() for p in out.iterdir()} == {f"{k} x.txt": f"text {k}" for k in range(6)}
    with pytest.raises(Exception, match="not a plain file name"):
        sink.write_files(spark.createDataFrame([("a.txt", "a"), ("../b", "b")], "file_name string, content string").repartition(2), str(out))
    assert {p.name for p in out.iterdir()} == {f"{k} x.txt" for k in range(6)}
    # a driver that dies behind its first move, and a job that dies while it stages
    half, dead = out / ".stage-1", out / ".stage-2"
    for d in (half, dead):
        d.mkdir()
        (d / "s1").write_text("later")
    (half / sink.MOVES).write_text(json.dumps([["s0", "0 x.txt"], ["s1", "7 x.txt"]]))
    sink.finish(str(out))
    assert {p.name for p in out.iterdir()} == {f"{k} x.txt" for k in (*range(6), 7)} and (out / "7 x.txt").read_text() == "later"
