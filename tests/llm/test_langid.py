import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import langid as L

SYLLABLES = {"aa": ["ba", "no", "ri", "ta"], "bb": ["sch", "ung", "über", "lich"], "cc": ["ção", "nho", "lhe", "ba"], "dd": ["ская", "ный", "про", "ест"]}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    return [(k, lang := r.choice(sorted(SYLLABLES)), prose(r, lang, r.randint(3, 60)).capitalize() + ".") for k in range(400)]


def frame(spark, rows):
    return spark.createDataFrame([(i, lang, t, "s", 1.0) for i, lang, t in rows], "doc_id long, lang string, text string, source string, score double")


def plain_grams(text):
    """N-grams by plain string work."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " " + " ".join(kept.split()) + " " if kept.split() else " "
    return [padded[k : k + n] for n in L.ORDERS for k in range(len(padded) - n + 1) if padded[k : k + n] != " "]


def plain_bucket(gram):
    h = len(gram)
    for k, c in enumerate(gram):
        h = (h + ord(c)) * int(L._PLACES[k]) % 2**64
    return h * int(L._MIX) % 2**64 >> 48


@pytest.mark.parametrize("text", ["", " ", "12 34", "a", "Über die Straße!! 17", "ab" * 40 + " -- " + "c", "é" * 9])
def test_buckets_against_strings(text, monkeypatch):
    expected = Counter(plain_bucket(g) for g in plain_grams(text))
    for size in (1 << 18, 1, 2, 3, 7):
        monkeypatch.setattr(L, "_SLICE", size)
        found = [x for a in L.gram_buckets(text, L.letters()) for x in a.tolist()]
        assert Counter(found) == expected


def brute(rows):
    """Predictions by dictionaries of whole counts."""
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts, docs = {}, Counter()
    for i, lang, t in rows:
        if i is not None and lang is not None and t is not None and not held(i):
            docs[lang] += 1
            counts.setdefault(lang, Counter()).update(plain_bucket(g) for g in plain_grams(t))
    out = []
    for i, _, t in rows:
        if t is None or not any(c.isalpha() for c in t):
            out.append((i, "und", 0.0))
            continue
        joint = {}
        for lang, c in counts.items():
            total = sum(c.values()) + L.SMOOTHING * L.BUCKETS
            joint[lang] = math.log(docs[lang] / docs.total()) + sum(n * math.log((c[b] + L.SMOOTHING) / total) for b, n in Counter(map(plain_bucket, plain_grams(t))).items())
        best = min(joint, key=lambda x: (-joint[x], x))
        out.append((i, best, 1 / sum(math.exp(v - joint[best]) for v in joint.values())))
    return out


def test_equals_brute_force_and_is_right_on_held_out_rows(spark, rows):
    odd = [(None, "aa", "schung"), (900, None, "ção nho"), (901, "bb", None), (902, "bb", ""), (903, "cc", "12, 34"), (0, *rows[0][1:]), (904, "aa", "中文")]
    found = L.identify(frame(spark, rows + odd)).collect()
    expected = brute(rows + odd)
    by_key = lambda x: (x[0] is None, x[0] or 0, x[1], round(x[2], 6))
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in found), key=by_key)
    for a, b in zip(got, sorted(expected, key=by_key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-6)
    truth = {i: lang for i, lang, _ in rows}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)


def test_blocks_of_languages_give_the_same(spark, rows, monkeypatch):
    whole = sorted(map(str, L.identify(frame(spark, rows)).select("doc_id", "lang_pred").collect()))
    monkeypatch.setattr(L, "LANG_BLOCK", 3)
    blocks = L.identify(frame(spark, rows))
    assert sorted(map(str, blocks.select("doc_id", "lang_pred").collect())) == whole
    assert blocks.where("score < 0 or score > 1").count() == 0


def test_nothing_to_learn_and_empty(spark):
    assert [tuple(r)[2:] for r in L.identify(frame(spark, [(1, None, "word")])).collect()] == [("und", 0.0)]
    empty = L.identify(frame(spark, []))
    assert empty.columns == ["doc_id", "held_out", "lang_pred", "score"] and empty.collect() == []


def test_held_out_labels_are_not_used(spark, rows):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    lied = [(i, "zz" if held(i) else lang, t) for i, lang, t in rows]
    a, b = (sorted(map(str, L.identify(frame(spark, x)).collect())) for x in (rows, lied))
    assert a == b


def test_long_text_in_slices():
    text = "schung über " * 50_000
    letter = L.letters()
    matrix = np.log(np.random.default_rng(1).random((L.BUCKETS, 3)))
    one = L.score_texts([text], matrix, np.zeros(3), letter)[0]
    expected = sum(n * matrix[plain_bucket(g)] for g, n in Counter(plain_grams(text)).items())
    assert np.allclose(one, expected)
