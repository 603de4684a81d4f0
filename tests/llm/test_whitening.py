import math

import numpy as np
import pytest

from quire.llm import whitening as W


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n string")


def brute(rows, most=W.COMPONENTS):
    """{vec_id: (deviation, centred vector)}, covariance, by plain sums and numpy."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(kept), len(kept[0][1])
    sums = [sum(x[k] for _, x in kept) for k in range(d)]
    deviation = [sum((n * x[k] - sums[k]) ** 2 for k in range(d)) for _, x in kept]
    centred = np.array([[(n * x[k] - sums[k]) / n for k in range(d)] for _, x in kept])
    return [i for i, _ in kept], deviation, centred, centred.T @ centred / n


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    data = r.normal(0, 0.2, (300, 10)) @ r.normal(0, 1, (10, 10))
    return [(k, [float(c) for c in v], 1, "x") for k, v in enumerate(data)]


def test_against_numpy(spark, rows):
    odd = [(500, None, 1, "x"), (501, [None, *[0.5] * 9], 1, "x"), (502, [math.nan] * 10, 1, "x"), (503, [math.inf, *[0.0] * 9], 1, "x"), (None, rows[3][1], 1, "x"), rows[7]]
    found = W.whiten(frame(spark, rows + odd)).collect()
    ids, deviation, centred, cov = brute(rows + odd)
    n = len(ids)
    assert len(found) == n * 10 and {r.n for r in found} == {n}
    key = lambda i: -1 if i is None else i
    assert sorted((key(r.vec_id), r.component) for r in found) == sorted((key(i), c) for i in ids for c in range(1, 11))
    values = np.linalg.eigvalsh(cov)[::-1]
    by = {(r.vec_id, r.component): r for r in found}
    for i, dev, x in zip(ids, deviation, centred):
        own = [by[i, c] for c in range(1, 11)]
        assert {r.deviation for r in own} == {dev}
        # whatever the signs: the whitened vector has the Mahalanobis length
        assert sum(r.whitened**2 for r in own) == pytest.approx(x @ np.linalg.solve(cov, x), rel=1e-8)
    for c in range(1, 11):
        assert by[0, c].explained == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-9)
    w = np.array([[by[i, c].whitened for c in range(1, 11)] for i in ids])
    assert np.abs(w.T @ w / n - np.eye(10)).max() < 1e-9 and 0 <= found[0].identity_error < 1e-9
    for c in range(10):
        # each component is an eigenvector: whitened columns regress on centred entries with V a = e a
        axis = np.linalg.lstsq(centred, w[:, c], rcond=None)[0]
        assert np.allclose(cov @ axis, values[c] * axis, atol=1e-6 * values[0])


def test_tiles_give_the_same_sums(spark, rows, monkeypatch):
    df = spark.createDataFrame([([float(c) for c in v],) for _, v, *_ in rows], "v array<double>")
    whole = W.centred_products(df, "v", ["0.25D"] * 10)
    monkeypatch.setattr(W, "TILE", 4)
    assert np.allclose(W.centred_products(df, "v", ["0.25D"] * 10), whole)
    x = np.array([v for _, v, *_ in rows], float) - 0.25
    assert np.allclose(whole, x.T @ x)


def test_pairs_are_sums_of_one_aggregation(spark, rows):
    W.whiten(frame(spark, rows[:20]), 3).collect()
    df = W.integers(frame(spark, rows))
    assert df.columns == ["vec_id", "x"] and df.first().x == [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in rows[0][1]]


def test_components_without_variance_do_not_exist(spark):
    flat = [(k, [0.1 * k, 0.2 * k, 1.0], 1, "x") for k in range(12)]
    found = W.whiten(frame(spark, flat)).collect()
    assert {r.component for r in found} <= {1, 2} and all(math.isfinite(r.whitened) for r in found)
    assert W.whiten(frame(spark, [(1, [1.0, 2.0], 1, "x")] * 3)).collect() == []
    for none in ([], [(1, None, 1, "x")], [(1, [], 1, "x")]):
        empty = W.whiten(frame(spark, none))
        assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_other_lengths_and_great_entries(spark, rows):
    a = W.whiten(frame(spark, rows[:50] + [(900, [1.0, 2.0], 1, "x"), (901, [], 1, "x")])).collect()
    assert {r.vec_id for r in a} == {i for i, *_ in rows[:50]}
    great = [(k, [float(2.0 ** (k % 50)), float(k), -float(2.0 ** (k % 40))], 1, "x") for k in range(60)]
    found = W.whiten(frame(spark, great)).collect()
    ids, deviation, *_ = brute(great)
    assert {(r.vec_id, r.deviation) for r in found} == {(i, d if d < 2**63 else None) for i, d in zip(ids, deviation)}
