"""Corpus statistics; every one is a partial and a final aggregate without a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.numerals import EXTRA
from quire.functions.text import char_count, paragraphs, punctuation_stats
from quire.operators.overlay import is_chapter


def char_counts(docs: DataFrame, *by: str) -> DataFrame:
    """(by..., n_docs, n_paras, n_chars): stripped characters of all non-blank lines."""
    return docs.groupBy(*by).agg(F.count("*").alias("n_docs"), F.sum(F.size(paragraphs(F.col("text")))).cast("long").alias("n_paras"), F.sum(char_count(F.col("text"))).cast("long").alias("n_chars"))


def main_and_extra(files: DataFrame, *by: str) -> DataFrame:
    """(by..., n_main, n_extra) by file name; information and index files do not count."""
    extra = F.contains(F.col("file_name"), F.lit(EXTRA))
    return files.where(is_chapter(F.col("file_name"))).groupBy(*by).agg(F.count_if(~extra).alias("n_main"), F.count_if(extra).alias("n_extra"))


def numeric_total(value: Column) -> Column:
    """Sum of a JSON number's whole part; what is no number counts nothing."""
    return F.coalesce(F.sum(value.try_cast("double").cast("long")), F.lit(0))


def listing_total(first: Column, second: Column) -> Column:
    """Sum of the first count, or of the second where the first is missing or zero."""
    return F.coalesce(F.sum(F.coalesce(F.nullif(first, F.lit(0)), second, F.lit(0))), F.lit(0))


def newest(files: DataFrame, *by: str) -> DataFrame:
    """(by..., file_name): the file with the latest time, ties by the greater name."""
    return files.groupBy(*by).agg(F.max_by("file_name", F.struct("mtime", "file_name")).alias("file_name"))


def punctuation_table(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *[c.alias(n) for n, c in punctuation_stats(F.col("text")).items()])


def success_ratio(results: DataFrame) -> DataFrame:
    """(n_ok, n_total) of results (ok boolean)."""
    return results.agg(F.count_if("ok").alias("n_ok"), F.count("*").alias("n_total"))


def format_stats(titles: DataFrame, skipped: DataFrame) -> DataFrame:
    """(work_id, n_main, n_extra, n_skipped), works with skipped files alone included."""
    done = titles.groupBy("work_id").agg(F.count_if(~F.col("is_extra")).alias("n_main"), F.count_if("is_extra").alias("n_extra"))
    left = skipped.groupBy("work_id").agg(F.count("*").alias("n_skipped"))
    return done.join(left, "work_id", "full_outer").na.fill(0, ["n_main", "n_extra", "n_skipped"])
