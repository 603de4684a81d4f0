import random

import pytest

from quire.streaming import keyed
from quire.streaming.keyed import KeyedTable
from quire.streaming.upserts import current, keep_index

SCHEMA = "k long, role string, text string, at long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def state(table):
    return {(r.k, r.role): (r.text, r["at"]) for r in table.read(SCHEMA).collect()}


def test_batches_against_a_dictionary(spark, tmp_path):
    r, table, want = random.Random(1), KeyedTable(spark, str(tmp_path), ["k", "role"], "at", buckets=4), {}
    for n in range(9):
        rows = [(r.choice([None, *range(40)]), r.choice("ab"), f"t{n}-{i}", r.randint(0, 9) if i % 7 else None) for i in range(r.randint(0, 30))]
        assert table.put(frame(spark, rows), n)
        best = {}
        for k, role, text, at in rows:
            best[k, role] = max(best.get((k, role), (-1, "", None)), (-1 if at is None else at, text, at), key=lambda x: x[:2])
        want |= {key: (text, at) for key, (_, text, at) in best.items()}
        assert state(table) == want
    m = table.manifest()
    assert m.version == 9
    for parts in m.parts.values():
        assert all(a[1] * keyed.FOLD > b[1] for a, b in zip(parts, parts[1:]))


def test_bytes_written_follow_the_batch(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k", "role"], "at", buckets=8)
    text = lambda k: random.Random(k).randbytes(200).hex()
    table.put(frame(spark, [(k, "a", text(k), 0) for k in range(20_000)]), 0)
    first = sum(n for _, n in table.store.files("data"))
    for n in range(1, 11):
        before = dict(table.store.files("data"))
        table.put(frame(spark, [(k, "a", text(k + n), n) for k in range(n * 50, n * 50 + 100)]), n)
        written = sum(size for name, size in table.store.files("data") if name not in before)
        assert written < first / 20
    assert table.read().count() == 20_000 and table.read().where("at > 0").count() == 550


def test_replays_change_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k", "role"], "at", buckets=4)
    for n in range(3):
        assert table.put(frame(spark, [(n, "a", f"x{n}", 1)]), n, "one")
    before = table.store.files()
    assert not table.put(frame(spark, [(0, "a", "changed", 9)]), 1, "one") and not table.put(frame(spark, [(0, "a", "changed", 9)]), 2, "one")
    assert table.store.files() == before
    assert table.put(frame(spark, [(0, "a", "other stream", 0)]), 0, "two") and state(table)[0, "a"][0] == "other stream"


def test_a_batch_that_dies_midway_leaves_the_last_version(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path), ["k", "role"], "at", buckets=4)
    table.put(frame(spark, [(k, "a", "old", 1) for k in range(30)]), 0)
    want = state(table)

    def dies(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(table.store, "commit", dies)
        with pytest.raises(OSError):
            table.put(frame(spark, [(k, "a", "new", 2) for k in range(5)]), 1)
    assert state(table) == want
    orphans = len(table.store.names("data"))
    again = KeyedTable(spark, str(tmp_path), ["k", "role"], "at")
    again.put(frame(spark, [(k, "a", "new", 2) for k in range(5)]), 1)
    assert {k for k, v in state(again).items() if v[0] == "new"} == {(k, "a") for k in range(5)} and len(state(again)) == 30
    assert len(again.store.names("data")) <= orphans
    named = {p.split("/")[0] for v in again.versions() for parts in again.manifest(v).parts.values() for p, _ in parts}
    assert set(again.store.names("data")) == named


def test_another_writer_is_noticed(spark, tmp_path, monkeypatch):
    a, b = (KeyedTable(spark, str(tmp_path), ["k", "role"], "at", buckets=4) for _ in "ab")
    a.put(frame(spark, [(1, "a", "x", 1)]), 0)
    held = b.manifest()
    a.put(frame(spark, [(2, "a", "y", 1)]), 1)
    monkeypatch.setattr(b, "manifest", lambda *_: held)
    with pytest.raises(RuntimeError):
        b.put(frame(spark, [(3, "a", "z", 1)]), 1, "b")
    assert set(state(a)) == {(1, "a"), (2, "a")}


def test_one_key_reads_one_bucket(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k", "role"], "at", buckets=8)
    table.put(frame(spark, [(k, "a", f"t{k}", 1) for k in range(200)]), 0)
    one = table.read(where={"k": 17, "role": "a"})
    assert [r.text for r in one.collect()] == ["t17"] and len({f.split("/_bucket=")[1].split("/")[0] for f in one.inputFiles()}) == 1
    assert table.read(where={"k": 999, "role": "a"}).collect() == []


def test_stream_over_ten_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "k int, v string, at int"
    for n in range(10):
        spark.createDataFrame([(n % 4, f"v{n}", n), (100 + n, "once", 0)], schema).coalesce(1).write.mode("append").parquet(src)
        keep_index(spark.readStream.schema(schema).parquet(src), out, ck, ["k"], "at").awaitTermination()
    rows = {r.k: r.v for r in current(spark, out, schema, ["k"]).collect()}
    assert rows == {8 % 4: "v8", 9 % 4: "v9", 6 % 4: "v6", 7 % 4: "v7"} | {100 + n: "once" for n in range(10)}
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "t"), ["k"]).put(spark.createDataFrame([(1, 2)], "k int, _version int"), 0)
