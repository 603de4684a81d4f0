"""Long texts as numbered chunks, so that a text of any length is rows and never one cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.running import running
from quire.sources.scratch import once

#: Characters from the start of one chunk to that of the next, to the end of a part.
SIZE = 65_536


def chunked(parts: DataFrame, order: list[str], text: str = "text", by: str = "work_id", size: int = SIZE) -> DataFrame:
    """(by, chunk_no, offset, text) of parts (by, order..., text): the parts of a text in order, those that begin in the same stretch of
    ``size`` characters in one chunk. Chunks count from 1 without gaps, offset is in characters; joined in order they are the whole text.

    ``order`` names the parts of a text and puts them in order, nulls first. Null and empty parts add nothing.
    """
    held = once(parts.where(F.length(text) > 0).select(by, *order, F.col(text).alias("_text")))
    lengths = held.select(by, *order, F.char_length("_text").cast("long").alias("_n"))
    placed = running(lengths, [by], [F.col(c).asc_nulls_first() for c in order], {"_end": ("sum", F.col("_n"))}).withColumn("_at", F.col("_end") - F.col("_n"))
    stretch = F.expr(f"_at div {size}")
    begun = placed.groupBy(by, stretch.alias("_stretch")).agg(F.min("_at").alias("offset"))
    numbered = running(begun, [by], [F.col("_stretch")], {"chunk_no": ("sum", F.lit(1).cast("long"))})
    same: Column = F.lit(True)
    a, b = held.alias("a"), placed.alias("b")
    for c in [by, *order]:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    rows = a.join(b, same).select(F.col(f"a.{by}").alias(by), stretch.alias("_stretch"), "_at", "_text")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))), lambda p: p["_text"])
    texts = rows.groupBy(by, "_stretch").agg(F.array_join(pieces, "").alias("text"))
    t, n = texts.alias("t"), numbered.alias("n")
    return t.join(n, F.col(f"t.{by}").eqNullSafe(F.col(f"n.{by}")) & (F.col("t._stretch") == F.col("n._stretch"))).select(f"t.{by}", "n.chunk_no", "n.offset", "t.text")


def whole(chunks: DataFrame, by: str = "work_id") -> DataFrame:
    """(by, text): chunks put together again, for texts that fit a cell."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda p: p["text"])
    return chunks.groupBy(by).agg(F.array_join(pieces, "").alias("text"))
