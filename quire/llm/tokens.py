"""Token counts of whole texts from prefix dynamic programming (``prefix_bpe``)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batch_of, map_batches
from quire.llm.prefix_bpe import PrefixCounter

#: Tokens from which a text counts as too long.
LIMIT = 2048


def counter(path: str) -> PrefixCounter:
    """One counter, with its cache, for each worker process and vocabulary."""
    import builtins

    held = builtins.__dict__.setdefault("_quire_prefix_counters", {})
    if path not in held:
        held[path] = PrefixCounter(path)
    return held[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, limit_chars) for every row of docs (doc_id, text, ...).

    limit_chars is the length in code points of the longest prefix without white space at its end that keeps
    within the limit (the whole text if it does), inside words too. A null text counts as empty: no bytes, no tokens.
    Repeated rows stay; a null doc_id stays null; other columns are ignored; an empty table gives none.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [c.measure(t, limit) for t in texts]
            totals, cuts = [n for n, _ in found], [k for _, k in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals]), pa.array(cuts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"],
            )

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), per_batch, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")


def prefix_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ends array<int>, counts array<int>): the stored counts that answer any budget or offset.

    Nulls, empty texts, repeated rows and empty tables behave as in token_counts; the arrays are then empty.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            found = [c.boundaries(t) for t in b.column(1).to_pylist()]
            kind = pa.list_(pa.int32())
            yield batch_of({"doc_id": (b.column(0).to_pylist(), pa.int64()), "ends": ([e for e, _ in found], kind), "counts": ([n for _, n in found], kind)})

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), per_batch, "doc_id long, ends array<int>, counts array<int>")


def every_prefix(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, counts array<int>): element k is the number of tokens of the first k code points, k from 0 to the length.

    Nulls and empty texts have the one count 0; repeated rows and empty tables behave as in token_counts.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in batches:
            yield batch_of({"doc_id": (b.column(0).to_pylist(), pa.int64()), "counts": ([c.every_prefix(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))})

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), per_batch, "doc_id long, counts array<int>")


def longest_within(table: DataFrame, budget: int) -> DataFrame:
    """(doc_id, chars, n_tokens) of the longest prefix within a budget, white space included, from an every_prefix table alone."""
    k = F.array_max(F.transform("counts", lambda n, k: F.when(n <= budget, k)))
    return table.select("doc_id", k.cast("long").alias("chars"), F.element_at("counts", k + 1).cast("long").alias("n_tokens"))


def longest_prefix(table: DataFrame, budget: int) -> DataFrame:
    """(doc_id, chars, n_tokens) of the longest prefix within a budget, from a prefix_table alone."""
    k = F.size(F.filter("counts", lambda n: n <= budget))
    return table.select(
        "doc_id",
        F.when(k > 0, F.element_at("ends", F.greatest(k, F.lit(1)))).otherwise(F.lit(0)).cast("long").alias("chars"),
        F.when(k > 0, F.element_at("counts", F.greatest(k, F.lit(1)))).otherwise(F.lit(0)).cast("long").alias("n_tokens"),
    )
