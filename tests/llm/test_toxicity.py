import math
import random
import zlib

import pytest

from quire.llm import toxicity as T

BAD = ["vilest", "grubbler", "snorkfiend"]


@pytest.fixture(scope="module")
def data():
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    docs, labels = [], []
    for k in range(700):
        sentences = [" ".join(r.choice(words) for _ in range(8)) for _ in range(r.randint(1, 12))]
        toxic = k % 6 == 0
        if toxic:
            s = r.randrange(len(sentences))
            sentences[s] += " " + r.choice(BAD)
        docs.append((k, ". ".join(sentences).capitalize() + "."))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_location(spark, data):
    docs, labels = data
    docs = docs + [(None, "plain words"), (9000, None), (9001, ""), (0, docs[0][1])]
    d, l = frames(spark, docs, labels + [(5, None, None), (None, 1, 1), (0, 1, 0)])
    rows = T.toxicity(d, l).collect()
    assert len(rows) == len(docs)
    truth = {i: y for i, _, y in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    text = dict(docs)
    for r in held:
        if truth[r.doc_id]:
            assert any(b in text[r.doc_id][s.start : s.end] for s in r.offending for b in BAD)
    by = {r.doc_id: r for r in rows}
    assert by[9000].predicted == by[9001].predicted == 0 and 0 <= by[9000].score < 0.3
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_held_out_labels_do_not_matter(spark, data):
    docs, labels = data
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels]
    a = {r.doc_id: r.score for r in T.toxicity(*frames(spark, docs[:200], labels)).collect()}
    b = {r.doc_id: r.score for r in T.toxicity(*frames(spark, docs[:200], flipped)).collect()}
    assert a == b


def test_without_labels(spark, data):
    d, l = frames(spark, data[0][:5], data[1])
    assert all(r.predicted == 0 for r in T.toxicity(d, l.where("false")).collect())
    assert T.toxicity(d.where("false"), l).count() == 0


def test_noisy_or_matches_a_loop(spark, data):
    d, l = frames(spark, *data)
    sample, sizes = T.training_sample(d, l)
    model = T.fit(T.bags_of(sample), sizes)
    assert 0 < model.leak <= T.MAX_LEAK and any(b in w for w in model.weights for b in BAD)
    text = dict(data[0])
    for r in T.toxicity(d, l).collect()[:200]:
        clean, spans = 1 - model.leak, []
        for a, e in T.sentences(text[r.doc_id]):
            words = {w.strip(T._EDGES) for w in text[r.doc_id][a:e].lower().split()} - {""}
            known = [x for f, x in model.weights.items() if any(f == w or (f[-1] == "-" and len(w) > len(f) - 1 and w.startswith(f[:-1])) for w in words)]
            p = 1 / (1 + math.exp(-(T.BIAS + sum(known)))) if known else 0.0
            if p >= T.FLOOR:
                clean *= 1 - p
                spans.append((a, e, round(p, 9)))
        assert abs(r.score - (1 - clean)) < 1e-9
        assert [(s.start, s.end, round(s.score, 9)) for s in r.offending] == [s for s in spans if s[2] >= 0.3]


def test_length_alone_never_convicts(spark, data):
    docs, labels = data
    clean = [t for (i, t), (_, _, y) in zip(docs, labels) if not y]
    long = " ".join(clean[k % len(clean)] for k in range(4000))
    assert len(T.sentences(long)) >= 20_000
    d, l = frames(spark, docs + [(5000, long), (5001, "unseen things. " * 20_000), (5002, long + " You " + BAD[0] + ".")], labels)
    by = {r.doc_id: r for r in T.toxicity(d, l).where("doc_id >= 5000").collect()}
    assert by[5000].score < 0.3 and by[5001].score < 0.3 and not by[5000].offending
    assert by[5002].predicted == 1 and len(by[5002].offending) == 1


def test_every_predicted_text_has_an_offending_sentence():
    model = T.Model(0.05, {})
    weak = [{"start": k, "end": k + 1, "score": s} for k, s in enumerate((0.12, 0.2, 0.15))]
    score = model.bag([s["score"] for s in weak])
    assert score >= 0.3 and [s["start"] for s in T.offending(weak, score, model)] == [1, 2]
    assert T.offending([], 0.05, model) == []
