"""Volumes: named inclusive ranges over chapter numbers, and the reading order they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.running import running
from quire.sources.scratch import once


def valid_volumes(volumes: DataFrame) -> DataFrame:
    """volumes (work_id, pos, name, start, end) that have a name and 0 <= start <= end (end defaults to start), with vol_no by start."""
    end = F.coalesce("end", "start")
    kept = volumes.withColumn("end", end).where((F.coalesce("name", F.lit("")) != "") & (F.col("start") >= 0) & (F.col("start") <= F.col("end")))
    return kept.withColumn("vol_no", F.row_number().over(Window.partitionBy("work_id").orderBy("start", "pos")))


#: Chapters of a volume that are laid out at once.
_BLOCK = 4096


def in_ranges(chapters: DataFrame, volumes: DataFrame) -> DataFrame:
    """Every (chapter, volume) with start <= ord <= end, however large the numbers.

    A sweep over the chapter numbers of a work and the ends of its volumes counts the numbers before each: a volume becomes a
    range of places among the numbers that exist, which is as long as the result, and the join an equi-join on places.
    """
    whole = "decimal(38,0)"
    held = volumes.select("work_id", "vol_no", F.col("name").alias("volume"), F.col("start").cast(whole).alias("start"), F.col("end").cast(whole).alias("end")).distinct()
    numbers = chapters.where("ord > 0").select("work_id", F.col("ord").cast(whole).alias("at")).distinct()
    edge = lambda at, kind: held.select("work_id", F.col(at).alias("at"), F.lit(kind).alias("kind"), "vol_no", "volume", "start", "end")
    none = [F.lit(None).cast(held.schema[c].dataType).alias(c) for c in ("vol_no", "volume", "start", "end")]
    # at one place a start comes before the number and an end behind it
    events = numbers.select("work_id", "at", F.lit(1).alias("kind"), *none).unionByName(edge("start", 0)).unionByName(edge("end", 2))
    placed = once(running(events, ["work_id"], [F.col("at"), F.col("kind"), F.col("vol_no"), F.col("volume"), F.col("end")], {"place": ("sum", (F.col("kind") == 1).cast("long"))}))
    spans = placed.where("kind <> 1").groupBy("work_id", "vol_no", "volume", "start", "end").agg((F.min("place") + 1).alias("low"), F.max("place").alias("high")).where("low <= high")
    blocks = spans.withColumn("block", F.explode(F.expr(f"sequence(low div {_BLOCK}, high div {_BLOCK})")))
    places = blocks.withColumn("place", F.explode(F.expr(f"sequence(greatest(low, block * {_BLOCK}), least(high, block * {_BLOCK} + {_BLOCK - 1}))"))).drop("block", "low", "high")
    numbered = placed.where("kind = 1").select("work_id", "at", "place").join(places, ["work_id", "place"]).drop("place")
    return chapters.where("ord > 0").withColumn("at", F.col("ord").cast(whole)).join(numbered, ["work_id", "at"]).drop("at")


def assign_first(chapters: DataFrame, volumes: DataFrame) -> DataFrame:
    """(work_id, chapter_key, ord, vol_no, volume): the first volume that holds each numbered chapter."""
    return in_ranges(chapters, volumes).groupBy("work_id", "chapter_key", "ord").agg(F.min(F.struct("vol_no", "volume")).alias("v")).select("work_id", "chapter_key", "ord", "v.vol_no", "v.volume")


def headings(chapters: DataFrame, volumes: DataFrame) -> DataFrame:
    """(work_id, chapter_key, vol_no, volume): the heading before a volume's first chapter; of volumes that share it the later one."""
    first = in_ranges(chapters, volumes).groupBy("work_id", "vol_no", "volume").agg(F.min_by("chapter_key", F.struct("ord", "chapter_key")).alias("chapter_key"))
    return first.groupBy("work_id", "chapter_key").agg(F.max(F.struct("vol_no", "volume")).alias("v")).select("work_id", "chapter_key", "v.vol_no", "v.volume")


def spine(chapters: DataFrame, volumes: DataFrame) -> DataFrame:
    """(work_id, kind, chapter_key, vol_no, title, play_order): chapters in order, each volume's page before its first chapter.

    A chapter belongs to the first volume that holds it; volumes without chapters have no page.
    """
    owned = assign_first(chapters, volumes).select("work_id", "chapter_key", "vol_no", "volume")
    rows = chapters.select("work_id", "chapter_key", "ord").join(owned, ["work_id", "chapter_key"], "left")
    placed = once(running(rows, ["work_id"], [F.col("ord").isNull(), F.col("ord"), F.col("chapter_key")], {"place": ("sum", F.lit(1))}))
    pages = placed.where("vol_no is not null").groupBy("work_id", "vol_no", "volume").agg(F.min("place").alias("place"))
    items = placed.select("work_id", F.lit("chap").alias("kind"), "chapter_key", "vol_no", F.col("chapter_key").alias("title"), "place", F.lit(1).alias("after")).unionByName(
        pages.select("work_id", F.lit("vol").alias("kind"), F.lit(None).cast("string").alias("chapter_key"), "vol_no", F.col("volume").alias("title"), "place", F.lit(0).alias("after"))
    )
    ordered = running(items, ["work_id"], [F.col("place"), F.col("after"), F.col("vol_no")], {"play_order": ("sum", F.lit(1))})
    return ordered.withColumn("play_order", F.col("play_order").cast("int")).drop("place", "after")


def nested(items: DataFrame) -> DataFrame:
    """items with parent: the play order of the volume page that a run of its chapters follows, null outside."""
    page = F.when(F.col("kind") == "vol", F.struct("play_order", "vol_no"))
    return running(items, ["work_id"], [F.col("play_order")], {"_p": ("max", page)}).withColumn("parent", F.when((F.col("kind") == "chap") & (F.col("_p.vol_no") == F.col("vol_no")), F.col("_p.play_order"))).drop("_p")


def overlaps(volumes: DataFrame) -> DataFrame:
    """Volumes that begin before an earlier one of their work has ended."""
    w = Window.partitionBy("work_id").orderBy("start", "pos").rowsBetween(Window.unboundedPreceding, -1)
    return volumes.withColumn("reach", F.max("end").over(w)).where("start <= reach").drop("reach")


def volumes_json(ranges: DataFrame) -> DataFrame:
    """(work_id, json): the volumes of each work as a JSON list of name, start and end, by start."""
    rows = F.array_sort(F.collect_list(F.struct("start", "end", "name")))
    return ranges.groupBy("work_id").agg(F.to_json(F.transform(rows, lambda v: F.struct(v["name"].alias("name"), v["start"].alias("start"), v["end"].alias("end")))).alias("json"))
