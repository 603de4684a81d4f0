"""Language identification by multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, everything but letters and their marks becomes one space, and
its n-grams of one to three characters are hashed into 65,536 buckets. Bucket counts of
each language are summed over all training rows where they lie; the smoothed logarithms
of their shares form a matrix of buckets by languages that is broadcast. A batch of
texts becomes a sparse matrix (row, bucket, count), whose product with it, plus the
logarithms of the languages' shares of documents, scores every language in numpy.

A matrix has at most LANG_BLOCK languages (32 MB); more languages are scored block by
block, each text keeping its best language and the sum over all of them, so the result
is that of one matrix however many there are.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Added to each count.
SMOOTHING = 0.5
HELD_OUT = 2
#: Languages of one matrix, and of a table at most: a column with more distinct values than there are languages is none.
LANG_BLOCK, MAX_LANGS = 64, 10_000
UNKNOWN = "und"
#: Characters of a text, and n-grams of a batch, that arrays are made of at once.
_SLICE, _GRAMS = 1 << 18, 1 << 20
_SPACE = 32
# Odd multipliers of a character's place in an n-gram, and of its order and the final mixing.
_PLACES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letters() -> np.ndarray:
    """Whether each code point of the basic plane is a letter or a mark on one."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x10000)])


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def gram_buckets(text: str, letter: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a whole text, slice by slice; n-grams across slices included, a lone space not."""
    tail = np.array([_SPACE], np.uint32)
    for at in range(0, len(text) + 1, _SLICE):
        part = np.frombuffer(text[at : at + _SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        part = np.where(letter[np.minimum(part, 0xFFFF)] | (part > 0xFFFF), part, np.uint32(_SPACE))
        if at + _SLICE > len(text):
            part = np.append(part, np.uint32(_SPACE))
        joined = np.concatenate([tail, part])
        new = np.ones(len(joined), bool)
        new[1:] = (joined[1:] != _SPACE) | (joined[:-1] != _SPACE)
        chars = joined[new].astype(np.uint64)
        # only n-grams that end behind the tail are new
        for n in ORDERS:
            starts = np.arange(max(0, len(tail) - n + 1), len(chars) - n + 1)
            if n == 1:
                starts = starts[chars[starts] != _SPACE]
            h = np.full(len(starts), n, np.uint64)
            for k in range(n):
                h = (h + chars[starts + k]) * _PLACES[k]
            yield ((h * _MIX) >> np.uint64(48)).astype(np.int64)
        tail = chars[1 - max(ORDERS) :].astype(np.uint32)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == HELD_OUT


def bucket_counts(train: DataFrame, langs: list[str]) -> np.ndarray:
    """Counts of buckets by languages over all rows of train (lang, text); summed per task, then by key, so the driver gets at most one matrix."""
    number = {lang: k for k, lang in enumerate(langs)}

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, counts = letters(), np.zeros((len(langs), BUCKETS), np.int64)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for found in gram_buckets(text, letter):
                    counts[number[lang]] += np.bincount(found, minlength=BUCKETS)
        for k in range(len(langs)):
            at = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[k][at])], names=["lang", "bucket", "n"])

    rows = train.where(F.col("lang").isin(langs)).select("lang", "text")
    sums = map_batches(rows, per_batch, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((BUCKETS, len(langs)))
    out[sums["bucket"].to_numpy(), sums["lang"].to_numpy()] = sums["n"].to_numpy()
    return out


def log_shares(counts: np.ndarray) -> np.ndarray:
    """Smoothed log-probabilities of the buckets, by columns."""
    return np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * len(counts))


def score_texts(texts: list[str], matrix: np.ndarray, prior: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Log joint probabilities, texts by languages: sparse counts of at most _GRAMS n-grams at a time against the matrix."""
    scores, held, size = np.tile(prior, (len(texts), 1)), [], 0

    def settle() -> None:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        row, bucket = keys // BUCKETS, keys % BUCKETS
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        scores[row[first]] += np.add.reduceat(n[:, None] * matrix[bucket], first)

    for k, text in enumerate(texts):
        for found in gram_buckets(text, letter):
            held.append(found + k * BUCKETS)
            size += len(found)
            if size >= _GRAMS:
                settle()
                held, size = [], 0
    if size:
        settle()
    return scores


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs (doc_id, text, lang, ...).

    Trained on all rows with a text, a lang and a doc_id outside the held-out fold; score is the share of the predicted
    language in the sum over all languages. A text that is null or has no letter is ``und`` with score 0, and so is any
    text if no row can be learned from; equal scores go to the lang that is first by code point. A null doc_id is not
    held out and not learned from. Repeated rows count each time and stay repeated; other columns are ignored; an empty
    table gives no rows. More than MAX_LANGS values of lang raise ValueError.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    train = rows.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    sizes = sorted((r.lang, r.n) for r in train.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect())
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"lang has more than {MAX_LANGS} values")
    langs, total = [lang for lang, _ in sizes], sum(n for _, n in sizes)
    priors = np.array([math.log(n / total) for _, n in sizes])
    out = rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text", F.lit(UNKNOWN).alias("lang_pred"), F.lit(-math.inf).alias("top"), F.lit(-math.inf).alias("mass"))
    for at in range(0, len(langs), LANG_BLOCK):
        block = langs[at : at + LANG_BLOCK]
        matrix = spark.sparkContext.broadcast((log_shares(bucket_counts(train, block)), priors[at : at + LANG_BLOCK]))
        out = _scored(out, block, matrix)
    return out.select("doc_id", "held_out", "lang_pred", F.when(F.col("lang_pred") == UNKNOWN, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.exp(F.col("top") - F.col("mass")))).alias("score"))


def _scored(rows: DataFrame, block: list[str], matrix) -> DataFrame:
    """rows with the languages of a block scored: top is the log joint probability of the best so far, mass that of all so far."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letters()
        shares, prior = matrix.value
        for b in batches:
            texts = b.column(2).to_pylist()
            lettered = [k for k, t in enumerate(texts) if has_letter(t)]
            lang, top, mass = np.array(b.column(3).to_pylist(), object), b.column(4).to_numpy().copy(), b.column(5).to_numpy().copy()
            if lettered:
                scores = score_texts([texts[k] for k in lettered], shares, prior, letter)
                best, at = scores.argmax(axis=1), np.array(lettered)
                most = scores.max(axis=1)
                better = most > top[at]
                lang[at[better]] = np.array(block, object)[best[better]]
                top[at] = np.maximum(top[at], most)
                mass[at] = np.logaddexp(mass[at], np.logaddexp.reduce(scores, axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(lang, pa.string()), pa.array(top), pa.array(mass)], names=b.schema.names)

    return map_batches(rows, per_batch, rows.schema)
