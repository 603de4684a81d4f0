"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag has a label. Words and their
beginnings are features; those that go with the label in a sample are kept. A
sentence with such features scores p = sigmoid(bias + sum of their weights), any
other sentence 0, and the bag scores 1 - (1 - leak) * product(1 - p), the noisy-or
of its sentences; the leak, one for each document, stands for labels that no
sentence explains. Weights and leak are trained by gradient descent on the
bags' likelihood, so blame settles on the sentences that carry it. Sentences below
a floor do not count, so length alone never convicts; afterwards the sentence scores
locate the offending ones.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batch_of, cut, map_batches

#: Rows of each label that a model is fitted on at most, taken in the order of a hash of doc_id.
SAMPLE_PER_LABEL = 3000
HELD_OUT = 2
THRESHOLD = 0.3
#: A word is a feature if its share of toxic bags is this many standard errors off that of all bags.
MIN_Z = 5.0
STEPS, RATE, DECAY = 400, 0.1, 2e-4
#: The bias of a sentence (fixed: a fitted one grows until common words convict), the score below which it is
#: blank, and what a leak is at most.
BIAS, FLOOR, MAX_LEAK = -4.0, 0.1, 0.2
#: Features that a model has at most, those farthest from chance.
MAX_FEATURES = 20_000
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_/\\"
_CACHE_WORDS = 400_000


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences, as code points."""
    return [m.span() for m in _SENTENCE.finditer(text)]


def features_of(raw: str) -> tuple[str, ...]:
    """What a lower-cased word stands for: itself, and its beginnings of 5, 6 and 7 characters."""
    w = raw.strip(_EDGES)
    return (w, *(f"{w[:n]}-" for n in (5, 6, 7) if len(w) > n)) if w else ()


def sentence_features(sentence: str) -> set[str]:
    return {f for raw in set(sentence.lower().split()) for f in features_of(raw)}


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> tuple[DataFrame | None, dict[int, int]]:
    """((doc_id, toxic, text), rows of each label): a bounded sample of the labelled rows outside the held-out fold.

    The largest label of a doc_id counts, and the first text in its hash order; null labels and ids are not used.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r.toxic in (0, 1)}
    picked = None
    for label in sizes:
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        picked = part if picked is None else picked.union(part)
    if picked is None:
        return None, sizes
    # at most 2 * per_label ids: a proven bound for the broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    return texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")), sizes


@dataclass
class Bags:
    """What is kept of a sample: for each bag its label and, for each of its sentences with any, the numbers of its features."""

    labels: list[int] = field(default_factory=list)
    sentences: list[list[list[int]]] = field(default_factory=list)
    vocabulary: list[str] = field(default_factory=list)


def screened(sample: DataFrame, n: int, toxic: int) -> list[str]:
    """Features whose presence in a text goes with its label beyond chance, in the order of code points; counted where the texts lie."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        in_toxic: Counter[str] = Counter()
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                features = sentence_features(text or "")
                seen.update(features)
                if y:
                    in_toxic.update(features)
            if len(seen) > _CACHE_WORDS:
                yield counted(seen, in_toxic)
                seen.clear(), in_toxic.clear()
        yield counted(seen, in_toxic)

    def counted(seen: Counter[str], in_toxic: Counter[str]) -> pa.RecordBatch:
        return batch_of({"feature": (list(seen), pa.string()), "k": (list(seen.values()), pa.int64()), "k_toxic": ([in_toxic[w] for w in seen], pa.int64())})

    if toxic in (0, n):
        return []
    rate = toxic / n
    counts = map_batches(sample.select("toxic", "text"), per_batch, "feature string, k long, k_toxic long").groupBy("feature").agg(F.sum("k").alias("k"), F.sum("k_toxic").alias("t"))
    z = F.abs(F.col("t") - F.col("k") * rate) / F.sqrt(F.col("k") * F.lit(rate * (1 - rate)))
    far = counts.where(F.col("k") >= 3).select("feature", z.alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES)
    return sorted(r.feature for r in far.collect())


def bags_of(sample: DataFrame | None) -> Bags:
    """The sample reduced to feature numbers on the executors; no text reaches the driver."""
    if sample is None:
        return Bags()
    sample = cut(sample)
    totals = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    vocabulary = screened(sample, totals.n, totals.toxic or 0)
    number = {w: k for k, w in enumerate(vocabulary)}

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [[sorted(number[f] for f in found) for a, e in sentences(t or "") if (found := sentence_features((t or "")[a:e]) & number.keys())] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bags, pa.list_(pa.list_(pa.int32())))], names=["doc_id", "toxic", "bag"])

    rows = sorted((r.doc_id, r.toxic, r.bag) for r in map_batches(sample.select("doc_id", "toxic", "text"), per_batch, "doc_id long, toxic int, bag array<array<int>>").collect())
    return Bags([y for _, y, _ in rows], [bag for _, _, bag in rows], vocabulary)


@dataclass
class Model:
    leak: float
    weights: dict[str, float]

    def sentence(self, features: set[str]) -> float:
        """The score of a sentence, 0 if it is blank."""
        known = [self.weights[f] for f in features if f in self.weights]
        if not known:
            return 0.0
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, BIAS + sum(known)))))
        return p if p >= FLOOR else 0.0

    def bag(self, scores: list[float]) -> float:
        """The noisy-or of sentence scores and the leak."""
        return -math.expm1(math.log1p(-self.leak) + sum(math.log1p(-p) for p in scores if p))


def fit(bags: Bags, sizes: dict[int, int]) -> Model:
    """Bags are weighted so that either label counts as in all labelled rows."""
    y = np.array(bags.labels, float)
    if len(set(bags.labels)) < 2:
        rate = (sum(bags.labels) + 0.5) / (len(bags.labels) + 1) if bags.labels else 0.05
        return Model(min(rate, MAX_LEAK), {})
    bag_of, sent, word = array("i"), array("i"), array("i")
    for k, bag in enumerate(bags.sentences):
        for features in bag:
            sent.extend([len(bag_of)] * len(features))
            word.extend(features)
            bag_of.append(k)
    bag_of, sent, word = (np.array(x, np.int32) for x in (bag_of, sent, word))
    share = {label: sizes[label] / max(1, int((y == label).sum())) for label in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    weight /= weight.sum()
    n_sent, n_word = len(bag_of), len(bags.vocabulary)
    # the weights, then the leak as a logit
    x = np.concatenate([np.zeros(n_word), [-3.0]])
    m, v, most = np.zeros(n_word + 1), np.zeros(n_word + 1), math.log(MAX_LEAK / (1 - MAX_LEAK))
    for step in range(1, STEPS + 1):
        z = np.clip(BIAS + np.bincount(sent, x[word], n_sent), -30, 30)
        p, leak = 1 / (1 + np.exp(-z)), 1 / (1 + math.exp(-x[-1]))
        log_clean = math.log1p(-leak) + np.bincount(bag_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))
        score = np.clip(1 - np.exp(log_clean), 1e-9, 1 - 1e-9)
        # d log-likelihood / dz of a sentence is p (y - score) / score, and of the leak alike
        pull = weight * (y - score) / score
        dz = pull[bag_of] * p
        g = np.concatenate([-np.bincount(word, dz[sent], n_word) + DECAY * x[:n_word], [-(pull * leak).sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - RATE * math.sqrt(1 - 0.999**step) / (1 - 0.9**step) * m / (np.sqrt(v) + 1e-8)
        x[-1] = min(x[-1], most)
    return Model(float(1 / (1 + math.exp(-x[-1]))), {t: float(w) for t, w in zip(bags.vocabulary, x) if abs(w) >= 1e-3})


def toxicity(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """(doc_id, held_out, score, predicted, offending) for every row of docs (doc_id, text, ...).

    offending lists (start, end, score) of sentences scoring 0.3 or more, in code points, in text order; if a
    predicted text has none, the fewest best sentences whose noisy-or reaches 0.3. So a predicted text has
    one, and texts without, null and empty ones among them, score the leak, below 0.3. A null doc_id is not
    held out. Without labels of both kinds the score only reflects the label rate. Repeated rows stay, other
    columns are ignored, an empty table gives no rows. Labels, lang, source and doc_id never enter a score.
    """
    sample, sizes = training_sample(docs, labels, per_label)
    model = fit(bags_of(sample), sizes)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        weights = model.weights

        def weighted(raw: str) -> tuple[str, ...]:
            """The features of a word that have a weight; nearly always none."""
            x = known.get(raw)
            if x is None:
                if len(known) >= _CACHE_WORDS:
                    known.clear()
                x = known[raw] = tuple(f for f in features_of(raw) if f in weights)
            return x

        for b in batches:
            scores, found = [], []
            for text in b.column(2).to_pylist():
                text = text or ""
                counted = []
                lowered = text.lower()
                same = len(lowered) == len(text)
                for start, end in sentences(text):
                    raw = (lowered[start:end] if same else text[start:end].lower()).split()
                    hits = {f for r in raw for f in weighted(r)}
                    if hits and (p := model.sentence(hits)):
                        counted.append({"start": start, "end": end, "score": p})
                score = model.bag([s["score"] for s in counted])
                scores.append(score)
                found.append(offending(counted, score, model))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(found, kind)],
                names=["doc_id", "held_out", "score", "predicted", "offending"],
            )

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_batches(wanted, per_batch, "doc_id long, held_out boolean, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")


def offending(counted: list[dict], score: float, model: Model) -> list[dict]:
    """The sentences that make a text toxic, in text order; see toxicity."""
    over = [s for s in counted if s["score"] >= THRESHOLD]
    if over or score < THRESHOLD:
        return over
    best = sorted(counted, key=lambda s: (-s["score"], s["start"]))
    for k in range(1, len(best) + 1):
        if model.bag([s["score"] for s in best[:k]]) >= THRESHOLD:
            return sorted(best[:k], key=lambda s: s["start"])
    return counted
