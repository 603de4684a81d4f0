import math
import random
from collections import Counter

import numpy as np

from quire.llm import quality as Q

WORDS = "the of and to in is that for it was on are as with be by this from house river green small people water light found".split()


def brute(text):
    text = text or ""
    for c in "\t\x0b\x0c\r":
        text = text.replace(c, " " if c != "\r" else "\r")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    hit = {k for i, w in enumerate(windows) if seen[w] > 1 for k in range(i, i + 8)}
    lines, dup, earlier = text.split("\n"), 0, set()
    for x in lines:
        if any(c not in " \t\n\x0b\x0c\r" for c in x):
            dup += x in earlier
            earlier.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def corpus():
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."
    rows = [(k, prose(r.randint(30, 150)), "en") for k in range(60)]
    rows += [(100, " ".join(f"{w}###" for w in prose(120).split()), "en"), (101, " ".join(f"{w.upper()}!!" for w in prose(120).split()), "en"), (102, " | ".join("zxqv" + str(k) for k in range(200)), "en")]
    rows += [(110, "a b c d e f g h " * 9, "en"), (111, "too short", "en"), (112, "", "en"), (113, None, "en"), (114, "x y\nx y\n\n \nx y", None), (None, prose(80), "xx"), (115, prose(60) * 2, "en"), (116, "w\x0bw\tw " * 4000, "en")]
    return rows + [rows[0], rows[0]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", -1, False) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_words int, kept boolean")


def test_base_counts_match_brute_force(spark):
    rows = corpus()
    got = sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.quality(frame(spark, rows)).collect()], key=str)
    want = []
    for i, t, _ in rows:
        b = brute(t)
        want.append((i, *b, b[0] < 20 or 100 * b[4] > 30 * b[0]))
    assert got == sorted(want, key=str)


def test_verdicts(spark):
    kept = {r.doc_id: r.kept for r in Q.quality(frame(spark, corpus())).collect()}
    assert all(kept[k] for k in range(60)) and kept[None]
    assert not any(kept[k] for k in (100, 101, 102, 110, 111, 112, 113, 114))
    assert Q.quality(frame(spark, corpus()).where("false")).count() == 0


def test_keep_good_is_the_verdict(spark):
    df = frame(spark, corpus())
    kept = Q.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in Q.quality(df).where("kept").collect())
    assert Q.keep_good(df.where("false")).count() == 0


def test_distance():
    p = np.array([[0.5, 0.5, 0], [1, 0, 0]])
    assert np.allclose(Q.js_distance(p, p).diagonal(), 0)
    assert np.isclose(Q.js_distance(np.array([[1.0, 0]]), np.array([[0, 1.0]]))[0, 0], 1)


def brute_verdicts(rows):
    """{index: kept} by loops: the means over passing rows, again over those near them, then the nearest distances."""
    profiler = Q.Profiler()
    found = [profiler.of(t) for _, t, _ in rows]
    failed = [b[0] < 20 or 100 * b[4] > 30 * b[0] for b, _, _ in found]

    def js(p, q):
        m = [(x + y) / 2 for x, y in zip(p, q)]
        kl = lambda a: sum(x * math.log2(x / z) for x, z in zip(a, m) if x > 0)
        return math.sqrt(max((kl(p) + kl(q)) / 2, 0))

    def share(h):
        return [x / sum(h) for x in h]

    def means(chosen, what):
        out = []
        for lang in sorted({rows[k][2] for k in chosen}):
            mine = [[round(1e6 * x / sum(found[k][what])) for x in found[k][what]] for k in chosen if rows[k][2] == lang]
            out.append(share([sum(col) for col in zip(*mine)]))
        return out

    def least(k, refs, what, size):
        h = found[k][what]
        return min((js(share(h), r) for r in refs), default=None) if sum(h) >= size else None

    good = [k for k in range(len(rows)) if not failed[k] and rows[k][2] in Q.COMMON_WORDS]
    first = means(good, 1)
    near = [k for k in good if (d := least(k, first, 1, Q.MIN_CHARS)) is not None and d <= Q.TRIM]
    classes, words = means(near, 1), means(near, 2)
    out = []
    for k in range(len(rows)):
        c, w = least(k, classes, 1, Q.MIN_CHARS), least(k, words, 2, Q.MIN_COMMON_WORDS)
        off = c is not None and (c > Q.FAR_CLASS or (c > Q.OFF_CLASS and w is not None and w > Q.OFF_WORD))
        out.append((rows[k][0], not failed[k] and not off, c and round(c, 5), w and round(w, 5)))
    return out


def test_verdicts_match_brute_force(spark):
    rows = corpus()
    got = Q.quality(frame(spark, rows))
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    rounded = [(r.doc_id, r.kept, r.class_distance and round(r.class_distance, 5), r.word_distance and round(r.word_distance, 5)) for r in got.collect()]
    assert sorted(rounded, key=str) == sorted(brute_verdicts(rows), key=str)


def test_keep_good_with_clashing_names(spark):
    df = frame(spark, corpus()).withColumnRenamed("n_words", "q_words").withColumnRenamed("kept", "Q_HIST")
    assert Q.keep_good(df).columns == df.columns and Q.keep_good(df).count() == Q.quality(df).where("kept").count()
