import random

from quire.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """sizes by source, None last; excess above the cap is dealt again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(cap * sizes[s] for s in full)
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] for s in full} | share
        full |= over


def corpus(n=900):
    r = random.Random(6)
    rows = [(k, "w " * int(r.paretovariate(1.2) * 20), r.choice(["a"] * 20 + ["b", "c", "é", "z", None])) for k in range(n)]
    return rows + [(5000, None, "empty"), (5001, "", "empty"), (None, "x y", "b")] + [(6000, "same words here", "a")] * 7


def test_mix(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], "doc_id long, text string, source string, size int, target string")
    got = mixing.mix(df).collect()
    assert sorted((str(r.doc_id), r.size, r.source or "") for r in got) == sorted((str(i), len((t or "").split()), s or "") for i, t, s in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    taken, most = {}, {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        rate = r.target / r.source_size if r.source_size else 0
        assert not r.size or int(rate) <= r.copies <= int(rate) + 1
        taken[r.source] = taken.get(r.source, 0) + r.taken
        most[r.source] = max(most.get(r.source, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] + 1
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.source or "", r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(df.where("false")).count() == 0


def test_rounding_keeps_expectations(spark):
    """Over many seeds each of four equal documents is taken about as often as its fraction says."""
    rows = [(g * 10 + k, "w " * 5, f"s{g:04d}") for g in range(600) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, weights=(3, 1)).collect()
    high = [r for r in got if int(r.source[1:]) % 2 == 0]
    assert {r.copies for r in high} == {1, 2} and abs(sum(r.copies == 2 for r in high) / len(high) - 0.5) < 0.05
    for k in range(4):
        mine = [r.copies == 2 for r in high if r.doc_id % 10 == k]
        assert abs(sum(mine) / len(mine) - 0.5) < 0.1


def test_no_words_at_all(spark):
    got = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in got} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_very_many_equal_rows(spark):
    df = spark.range(20_000).selectExpr("1L as doc_id", "'same five words are here' as text", "if(id < 15000, 'a', 'b') as source")
    got = mixing.mix(df).groupBy("source", "copies").count().collect()
    sizes = {"a": 75_000, "b": 25_000}
    want = brute_targets(sizes)
    for s, n in (("a", 15_000), ("b", 5_000)):
        own = {r.copies: r["count"] for r in got if r.source == s}
        assert sum(own.values()) == n and abs(sum(c * k * 5 for c, k in own.items()) - want[s]) <= 6


def test_levels_of_many_sources(spark):
    r = random.Random(4)
    rows = [(k, "w " * int(r.paretovariate(0.7) * 3), f"s{r.randrange(90):02d}" if k % 50 else None) for k in range(2000)]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    df = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, n long, source_size long")
    for weights in ((5, 2, 1), (7,), (1, 9)):
        want = brute_targets(sizes, weights)
        got = {x.source: x.target for x in mixing.source_targets(df, weights).collect()}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
