"""Paragraph-level comparison of two layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import first_difference, once, paragraphs
from quire.operators.overlay import KEY, pair

NO_TEXT = "array<string>"


def compare(base: DataFrame, corrected: DataFrame) -> DataFrame:
    """One row for each key: status (modified, renamed_only, unchanged, only_baseline, only_corrected), n_diffs, names and paragraphs.

    n_diffs counts ordinals at which the paragraphs differ, one side's surplus included. Null texts have no
    paragraphs. A chapter that is only in one layer has all its paragraphs as differences.
    """
    p = pair(base, corrected)
    none = F.array().cast(NO_TEXT)
    parts = once(p, paras_base=F.coalesce(paragraphs(F.col("base_text")), none), paras_corrected=F.coalesce(paragraphs(F.col("corrected_text")), none))
    differ = F.size(F.filter(F.zip_with("paras_base", "paras_corrected", lambda x, y: ~x.eqNullSafe(y)), lambda d: d)).cast("long")
    parts = once(parts, n_diffs=differ)
    status = (
        F.when(F.col("in_corrected").isNull(), "only_baseline")
        .when(F.col("in_base").isNull(), "only_corrected")
        .when(F.col("n_diffs") > 0, "modified")
        .when(F.col("base_name") != F.col("corrected_name"), "renamed_only")
        .otherwise("unchanged")
    )
    return parts.select(*KEY, status.alias("status"), "n_diffs", "base_name", "corrected_name", "paras_base", "paras_corrected")


def status_summary(compared: DataFrame) -> DataFrame:
    """(status, n_files, n_diffs)."""
    return compared.groupBy("status").agg(F.count("*").alias("n_files"), F.sum("n_diffs").alias("n_diffs"))


def paragraph_diffs(compared: DataFrame) -> DataFrame:
    """One row for each difference of chapters in both layers: line_no, kind (changed, only_in_1, only_in_2), pos, char1, char2, text1, text2.

    compat_line_no is the ordinal of a surplus paragraph that counts the shorter side twice.
    """
    both = compared.where("base_name is not null and corrected_name is not null")
    rows = both.select(*KEY, F.least(F.size("paras_base"), F.size("paras_corrected")).alias("shorter"), F.posexplode(F.arrays_zip("paras_base", "paras_corrected")).alias("at", "p"))
    rows = rows.select(*KEY, "shorter", (F.col("at") + 1).alias("line_no"), F.col("p.paras_base").alias("text1"), F.col("p.paras_corrected").alias("text2")).where("not (text1 <=> text2)")
    kind = F.when(F.col("text1").isNull(), "only_in_2").when(F.col("text2").isNull(), "only_in_1").otherwise("changed")
    rows = once(rows, kind=kind, d=F.when(F.col("text1").isNotNull() & F.col("text2").isNotNull(), first_difference(F.col("text1"), F.col("text2"))))
    compat = F.when(F.col("kind") == "changed", F.col("line_no")).otherwise(F.col("line_no") + F.col("shorter"))
    return rows.select(*KEY, "line_no", "kind", "d.*", "text1", "text2", compat.alias("compat_line_no"))


def preview(diffs: DataFrame, k: int) -> DataFrame:
    """The first k records of each chapter, with how many remain."""
    w = Window.partitionBy(*KEY)
    ranked = diffs.withColumn("rank", F.row_number().over(w.orderBy("line_no"))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("rank") <= k).withColumn("remaining", F.greatest(F.col("n") - k, F.lit(0))).drop("n")


def report(compared: DataFrame) -> DataFrame:
    """(work_id, report): one text for each work, its chapters in key order."""
    line = F.concat(F.lit("["), F.col("status"), F.lit("] "), F.coalesce("corrected_name", "base_name"), F.when(F.col("n_diffs") > 0, F.concat(F.lit(" ("), F.col("n_diffs").cast("string"), F.lit(")"))).otherwise(""))
    return compared.groupBy("work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_key", line.alias("line")))), lambda x: x["line"]), "\n").alias("report"))
