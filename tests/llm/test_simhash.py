import random

import numpy as np
import pytest
import xxhash

from quire.llm import components, simhash
from quire.llm.fingerprint_text import simhash as fingerprint

SCHEMA = "doc_id long, text string, fp string, root int, component_id int"


def brute_fingerprint(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows, radius=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            r = find(k)
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{fps[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed=3, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    texts = [" ".join(word() for _ in range(r.randint(1, 120))) for _ in range(n)]
    for _ in range(n // 2):  # copies and near copies
        words = r.choice(texts).split(" ")
        if r.random() < 0.6:
            words[r.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += ["", None, "  \t\n", "ONE Two\x0bthree", "one two three", "x" * 5000, "İ \x85 a b c d e"]
    return [(k if k % 29 else None, t) for k, t in enumerate(texts)] + [(7, texts[7]), (7, texts[7])]


def test_fingerprint_matches_definition():
    for _, t in corpus():
        assert fingerprint((t or "").encode()) == brute_fingerprint(t)


def test_components_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == brute_components(rows)
    assert simhash.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("radius", [2, 4])
def test_every_plan_is_exact(spark, radius):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 62, 60, dtype=np.uint64)
    fps = sorted({int(b) ^ sum(1 << int(x) for x in r.choice(64, r.integers(0, 6), replace=False)) for b in base for _ in range(4)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    counts = simhash.bit_counts(nodes)
    assert counts[5, 9] == sum(1 for f in fps if f >> 5 & 1 and f >> 9 & 1)
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= radius
    for n in (200, 10**8, 10**10):
        parts = simhash.plan_search(counts * (n / len(fps)), n, radius)
        assert sorted(b for p in parts for b in p.bits) == list(range(64))
        assert sum(p.threshold for p in parts) == radius - len(parts) + 1
        mine = signed if n < 10**10 else signed[::6] + signed[1::6]  # the largest plan has many probes
        # every fingerprint its own component: all links must be found
        held = spark.createDataFrame([(f, f) for f in mine], "fp long, comp long")
        assert {tuple(x) for x in simhash.cross_links(held, parts, radius).collect()} == {(a, b) for a in mine for b in mine if a < b and near(a, b)}
        # components of several members: a link for each pair of components with near members
        held = spark.createDataFrame([(f, k % 7) for k, f in enumerate(mine)], "fp long, comp long")
        assert {tuple(x) for x in simhash.cross_links(held, parts, radius).collect()} == {(i % 7, j % 7) for i, a in enumerate(mine) for j, b in enumerate(mine) if i % 7 < j % 7 and near(a, b)}
        seeds = {tuple(x) for x in simhash.seed_links(spark.createDataFrame([(f,) for f in mine], "fp long"), parts, radius).collect()}
        assert seeds <= {(a, b) for a in mine for b in mine if a < b and near(a, b)}


def reach(fps, radius=4):
    """The least fingerprint reachable, by search."""
    root, left = {}, set(fps)
    for f in sorted(fps):
        if f in root:
            continue
        todo = [f]
        left.discard(f)
        while todo:
            x = todo.pop()
            root[x] = f
            close = [y for y in left if ((x ^ y) & (2**64 - 1)).bit_count() <= radius]
            left.difference_update(close)
            todo += close
    return root


def test_dense_groups_have_links_in_proportion(spark):
    r = np.random.default_rng(4)
    counted = []
    for n in (150, 600):
        center = int(r.integers(0, 1 << 63))
        dense = {center ^ sum(1 << int(x) for x in r.choice(12, 2, replace=False) * 5) for _ in range(n)} | {center ^ sum(1 << int(x) for x in r.choice(62, 2, replace=False)) for _ in range(n)}
        chain = [int(r.integers(0, 1 << 62))]
        for _ in range(30):
            chain.append(chain[-1] ^ sum(1 << int(x) for x in r.choice(60, 4, replace=False)))
        fps = sorted(dense | set(chain) | {int(x) for x in r.integers(0, 1 << 62, 200)})
        nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
        parts = simhash.plan_search(simhash.bit_counts(nodes), len(fps))
        counted.append((len(dense), simhash.seed_links(nodes, parts).count()))
        got = {x.fp: x.root if x.root is not None else x.fp for x in simhash.components(nodes, parts).collect()}
        assert got == reach(fps)
    (n1, k1), (n2, k2) = counted
    assert k1 <= 12 * n1 and k2 <= 12 * n2


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(5, 5), (200, 201), (201, 200), (300, None)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    comps = brute_components(rows)
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None} == {c for _, _, c in comps if c is not None}
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert simhash.keep_one(df.where("false")).count() == 0
    assert simhash.keep_one(df.withColumnRenamed("root", "_fp").withColumnRenamed("fp", "_ID")).count() == kept.count()
