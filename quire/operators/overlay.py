"""Layers of a work: overlaying, pairing and key algebra.

A chapter table has work_id, chapter_key, file_name, text and, in layered tables,
layer and layer_rank; later ranks win. All joins are equi-joins on (work_id,
chapter_key), so one exchange serves pairing, overlaying and counting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import file_prefix
from quire.operators.chunks import SIZE, chunked

KEY = ["work_id", "chapter_key"]
#: Names of files beside the chapters: never chapters themselves.
RESERVED_NAMES = ("_source_map.txt", "插图信息.txt")


def with_keys(files: DataFrame) -> DataFrame:
    """files (work_id, file_name, ...) with prefix, ord and chapter_key: the leading digits, or else the whole name."""
    prefix = file_prefix(F.col("file_name"))
    return files.withColumns({"prefix": prefix, "ord": prefix.try_cast("decimal(38,0)"), "chapter_key": F.coalesce(prefix, F.col("file_name"))})


def is_reserved(name: Column) -> Column:
    """An index file or a file beside the chapters."""
    return name.startswith("series_") | name.startswith("_") | name.isin(*RESERVED_NAMES)


def is_chapter(name: Column) -> Column:
    """Not an information page (000), an index file or a reserved name."""
    return ~(name.startswith("000 ") | is_reserved(name))


def last_wins(chapters: DataFrame, *order: Column) -> DataFrame:
    """One row for each key: the last by order; the window keeps one row of a key per task before its shuffle."""
    w = Window.partitionBy(*KEY).orderBy(*[c.desc_nulls_last() for c in order])
    return chapters.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unique_prefixes(chapters: DataFrame) -> DataFrame:
    """Of several files with one key the greatest name stays; ties by text."""
    return last_wins(chapters, F.col("file_name"), F.xxhash64("text"))


def overlay(*layers: DataFrame) -> DataFrame:
    """The union of layers (work_id, chapter_key, file_name, text), later layers winning key by key; adds layer_rank."""
    stacked = None
    for rank, layer in enumerate(layers):
        part = layer.select(*KEY, "file_name", "text", F.lit(rank).alias("layer_rank"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return last_wins(stacked, F.col("layer_rank"), F.col("file_name"), F.xxhash64("text"))


def pair(base: DataFrame, corrected: DataFrame) -> DataFrame:
    """Full outer pairing: keys, base_* and corrected_* names and texts, in_base and in_corrected.

    Of files that share a key in one layer the last counts, so a repeated prefix never multiplies rows; the
    window's exchange serves the join.
    """
    side = lambda df, name: unique_prefixes(df).select(*KEY, F.col("file_name").alias(f"{name}_name"), F.col("text").alias(f"{name}_text"), F.lit(True).alias(f"in_{name}"))
    return side(base, "base").join(side(corrected, "corrected"), KEY, "full_outer")


def assemble(base: DataFrame, corrected: DataFrame) -> DataFrame:
    """The corrected chapter where there is one, else the base one, with lineage: origin, renamed and the name it replaces."""
    p = pair(base, corrected)
    taken = F.col("in_corrected").isNotNull()
    return p.select(
        *KEY,
        F.coalesce("corrected_name", "base_name").alias("file_name"),
        F.when(taken, F.col("corrected_text")).otherwise(F.col("base_text")).alias("text"),
        F.when(taken, F.lit("corrected")).otherwise(F.lit("baseline")).alias("origin"),
        F.coalesce(F.col("base_name") != F.col("corrected_name"), F.lit(False)).alias("renamed"),
        F.col("base_name").alias("replaces"),
    )


def assemble_summary(assembled: DataFrame) -> DataFrame:
    """One row: total, from_corrected, from_baseline, renamed; zeros for an empty table."""
    count = lambda c, name: F.count_if(c).alias(name)
    return assembled.agg(F.count("*").alias("total"), count(F.col("origin") == "corrected", "from_corrected"), count(F.col("origin") == "baseline", "from_baseline"), count(F.col("renamed"), "renamed"))


def missing(records: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Records without a file: a left anti join on the key, reading no text."""
    return records.join(files.select(key), key, "left_anti")


def existing(records: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Records with a file: a left semi join."""
    return records.join(files.select(key), key, "left_semi")


def pending(tasks: DataFrame, files: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Tasks still to do: all if forced, else those without a file."""
    return tasks if force else missing(tasks, files, key)


def chapter_order() -> list[Column]:
    """Numeric prefixes ascending, then names without a prefix by code point."""
    return [F.col("ord").isNull(), F.col("ord"), F.col("chapter_key")]


def format_order() -> list[Column]:
    """Names without a prefix count as zero and so come first; ties by name."""
    return [F.coalesce(F.col("ord"), F.lit(0)), F.col("file_name")]


def lineage_rows(assembled: DataFrame) -> DataFrame:
    """(work_id, chapter_key, text): for each chapter the line that says which layer it came from."""
    line = F.concat("file_name", F.lit(" <- "), "origin", F.when(F.col("renamed"), F.concat(F.lit(" (was "), "replaces", F.lit(")"))).otherwise(F.lit("")))
    return assembled.select("work_id", "chapter_key", line.alias("text"))


def lineage_lines(assembled: DataFrame) -> DataFrame:
    """(work_id, text): the lines of a work in key order, in one cell; ``lineage_chunks`` has no such bound."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("chapter_key").alias("k"), F.col("text").alias("line"))))
    return lineage_rows(assembled).groupBy("work_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def lineage_chunks(assembled: DataFrame, size: int = SIZE) -> DataFrame:
    """(work_id, chunk_no, offset, text): the same lines as numbered chunks, a line feed before each but the first."""
    rows = lineage_rows(assembled)
    first = rows.groupBy("work_id").agg(F.min("chapter_key").alias("first"))
    led = rows.join(first, "work_id").withColumn("text", F.when(F.col("chapter_key") == F.col("first"), F.col("text")).otherwise(F.concat(F.lit("\n"), "text")))
    return chunked(led.select("work_id", "chapter_key", "text"), ["chapter_key"], size=size)
