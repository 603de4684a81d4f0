import os

import pytest

from quire.sources import changes, config


def test_a_second_scan_reads_only_changed_files(spark, tmp_path):
    folder, state = tmp_path / "in", tmp_path / "state"
    scans = changes.Scans(spark, str(folder), str(state))
    ticket, none = scans.changes()
    assert none.collect() == []
    scans.commit(ticket)
    folder.mkdir()
    for k in range(6):
        (folder / f"{k:03d} a%20b.TXT").write_text(f"text {k}")
    (folder / "other.json").write_text("{}")
    ticket, found = scans.changes()
    assert {(r.file_name, r.change) for r in found.collect()} == {(f"{k:03d} a%20b.TXT", "new") for k in range(6)}
    got = changes.changed_chapters(found, "w").collect()
    assert {(r.chapter_key, r.text) for r in got} == {(f"{k:03d}", f"text {k}") for k in range(6)}
    # not committed: a scan that died is seen again
    assert scans.changes()[1].count() == 6
    scans.commit(scans.changes()[0])
    assert scans.changes()[1].count() == 0
    (folder / "001 a%20b.TXT").write_text("text one")
    os.utime(folder / "002 a%20b.TXT", (1, 1))
    (folder / "003 a%20b.TXT").unlink()
    (folder / "007 new.txt").write_text("seven")
    ticket, found = scans.changes()
    rows = {(r.chapter_key, r.change, r.text) for r in changes.changed_chapters(found, "w").collect()}
    assert rows == {("001", "changed", "text one"), ("002", "changed", "text 2"), ("003", "gone", None), ("007", "new", "seven")}
    # the contents of unchanged files are not in the plan: only rows of changed ones reach the reader
    assert changes.contents(found.where("change <> 'gone'")).count() == 3
    scans.commit(ticket)
    assert len(list(state.glob("listing-*"))) == 1 and len(list(state.glob("*.scan"))) == 1 and scans.changes()[1].count() == 0


@pytest.mark.parametrize(
    "text",
    ["no json", "[1]", "null", '{"a": {"align": "left", "size": "2em", "split": true}, "b": {"align": "right"}, "c": 1, "d": {}}', '{"chapter": {"x": {"color": "red", "underline": false, "split": 0}}}', '{"volume": {"v": {"vol_split": false, "vol_gap": "1em"}, "w": {}}}', '{"chapter": {}, "volume": {"v": {"desc": "d"}}}'],
)
def test_presets_as_rows_are_those_of_the_parser(spark, text):
    df = spark.createDataFrame([(1, text)], "k int, json string")
    for section, defaults in (("chapter", config.CHAPTER_STYLE), ("volume", config.VOLUME_STYLE)):
        got = {r.preset: {k: r[k] for k in defaults} for r in config.preset_rows(df, "k", section, defaults).collect()}
        assert got == config.parse_styles(text)[section]


def test_choices(spark):
    presets = config.preset_rows(spark.createDataFrame([(1, '{"a": {"size": "2em"}}'), (None, '{"a": {"size": "3em"}}')], "k int, json string"), "k", "chapter", config.CHAPTER_STYLE)
    choices = spark.createDataFrame([(1, "a", {"split": "true"}), (1, "z", None), (1, None, {"size": "5em"}), (2, "a", None), (None, "a", {})], "k int, preset string, given map<string,string>")
    got = {(r.k, r.preset): (r.known, r["size"], r["split"]) for r in config.resolved_styles(choices, presets, "k", config.CHAPTER_STYLE).collect()}
    assert got == {(1, "a"): (True, "2em", True), (1, "z"): (False, "1.5em", False), (1, None): (True, "5em", False), (2, "a"): (False, "1.5em", False), (None, "a"): (True, "3em", False)}


def test_a_scan_of_many_files_takes_few_tasks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(400):
        (folder / f"{k:03d} a.txt").write_text(f"text {k}")
    for name in (".x.txt", "_y.txt", "z.json"):
        (folder / name).write_text("no")
    (folder / "below.txt").mkdir()
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        found = changes.listing(spark, str(folder))
        assert found.rdd.getNumPartitions() <= 4 and found.count() == 400
        rows = {r.file_name: (r.path, r.length, r.mtime.timestamp()) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    # the same paths, lengths and times as Spark's own file source gives
    own = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(str(folder)).select("path", "length", "modificationTime").collect()
    assert {(p, n, t) for p, n, t in rows.values()} == {(r.path, r.length, r.modificationTime.timestamp()) for r in own}
    read = changes.contents(found)
    assert {bytes(r.content).decode() for r in read.collect()} == {f"text {k}" for k in range(400)} and read.rdd.getNumPartitions() == 4
