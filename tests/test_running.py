import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from quire.operators import running as R
from quire.operators import volumes


@pytest.mark.parametrize("limit", [10**9, 7])
def test_sums_and_maxima_against_loops(spark, limit):
    r = random.Random(4)
    rows = [(g, k, r.choice([None, *range(9)]), r.choice([None, *range(99)])) for k, g in enumerate(r.choice(["a", "a", "a", "a", "b", None]) for _ in range(400))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, v int, m int")
    got = R.running(df, ["g"], [F.col("k")], {"n": ("sum", F.lit(1)), "s": ("sum", F.col("v")), "top": ("max", F.struct("m", "k"))}, limit)
    assert got.columns == ["g", "k", "v", "m", "n", "s", "top"]
    found = {(x.g, x.k): (x.n, x.s, x.top.m) for x in got.collect()}
    for g in ("a", "b", None):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: x[1])
        some = list(accumulate((x[2] for x in own), lambda a, b: b if a is None else a if b is None else a + b))
        best = list(accumulate((x[3] for x in own), lambda a, b: b if a is None else a if b is None else max(a, b)))
        assert [found[g, x[1]] for x in own] == [(i + 1, s, m) for i, (s, m) in enumerate(zip(some, best))]
    assert len(found) == 400


def test_a_hot_group_spreads_over_all_tasks(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.lit("small")).otherwise(F.lit("hot")).alias("g"), "id")
    got = R.running(df, ["g"], [F.col("id")], {"n": ("sum", F.lit(1))}, 1_000).withColumn("p", F.spark_partition_id())
    window = R.Window.partitionBy("g").orderBy("id")
    assert got.join(df.select("id", F.row_number().over(window).alias("want")), "id").where("n <> want").count() == 0
    # dealt by ranges, no range holds more than a few times its share
    plan = got._jdf.queryExecution().toString()
    assert "_part" in plan
    assert R.running(df, ["g"], [F.col("id")], {"n": ("sum", F.lit(1))}, 1_000).groupBy("g").agg(F.max("n").alias("n")).orderBy("n").collect()[1].n == 18_000


def frames(spark, chapters, ranges):
    c = spark.createDataFrame(chapters, "work_id string, chapter_key string, ord string").withColumn("ord", F.expr("try_cast(ord as decimal(38,0))"))
    return c, volumes.valid_volumes(spark.createDataFrame(ranges, "work_id string, pos int, name string, start long, end long"))


@pytest.mark.parametrize("limit", [10**9, 5])
def test_volumes_against_loops(spark, monkeypatch, limit):
    monkeypatch.setattr(R.running, "__defaults__", (limit,))
    monkeypatch.setattr(volumes, "_BLOCK", 4)
    r = random.Random(6)
    chapters = [(w, f"{k}-{i}", r.choice([None, str(r.randint(0, 60)), "20240115001", "9" * 25])) for w in "abc" for i, k in enumerate(range(40))]
    ranges = [(w, p, f"V{p}", a := r.randint(0, 50), r.choice([a, a + 5, 99999999999])) for w in "abx" for p in range(6)]
    c, v = frames(spark, chapters, ranges)
    got = sorted((x.work_id, x.chapter_key, x.vol_no) for x in volumes.in_ranges(c, v).collect())
    order = {}
    for w in "abx":
        for n, x in enumerate(sorted((x for x in ranges if x[0] == w), key=lambda x: (x[3], x[1]))):
            order[w, n + 1] = x
    want = sorted((w, k, n) for w, k, o in chapters if o and int(o) > 0 for (vw, n), x in order.items() if vw == w and x[3] <= int(o) <= x[4])
    assert got == want


def test_one_odd_name_stops_nothing(spark):
    c, v = frames(spark, [("w", "1 a", "1"), ("w", "20240115001 x", "20240115001"), ("w", "y", "12345678901234567890")], [("w", 0, "all", 1, 99999999999), ("w", 1, "late", 2, 2**62)])
    assert sorted((x.chapter_key, x.volume) for x in volumes.assign_first(c, v).collect()) == [("1 a", "all"), ("20240115001 x", "all")]
    items = {(x.kind, x.title): x.play_order for x in volumes.spine(c, v).collect()}
    assert items == {("vol", "all"): 1, ("chap", "1 a"): 2, ("chap", "20240115001 x"): 3, ("chap", "y"): 4}
