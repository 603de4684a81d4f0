"""Index tables of a work: keyed records, last write wins, and their rendered views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import pad3

NO_DESCRIPTION = "（暂无简介）"


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """old with the rows of new put in by key; within new the last by order wins. Upserting the same rows again changes nothing."""
    if order:
        w = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
        new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("_old"))
    b = new.select(*keys, F.struct(*values).alias("_new"))
    return a.join(b, keys, "full_outer").select(*keys, F.coalesce("_new", "_old").alias("_v")).select(*keys, "_v.*")


def remove(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti")


def csv_field(c: Column) -> Column:
    """A value as a CSV writer puts it: in quotes if it holds a comma, a quote or a line break."""
    return F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def catalog(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """(by, csv): the catalog (by, series_id, title) of each owner with new titles put in, a line for each series in numeric order."""
    rows = upsert(old, new, [by, "series_id"])
    line = F.concat(csv_field(F.col("series_id")), F.lit(","), csv_field(F.col("title")), F.lit("\n"))
    number = F.col("series_id").try_cast("decimal(38,0)")
    held = F.array_sort(F.collect_list(F.struct(number.isNull().alias("a"), number.alias("n"), "series_id", line.alias("line"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(held, lambda r: r["line"]), "").alias("csv"))


def now_iso() -> Column:
    """The time of the query in the session's zone, to the second; not repeatable."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")


def record_rows(records: DataFrame) -> DataFrame:
    """records (chapter_num, novel_id) as written: padded numbers; rows whose number is no integer are left out."""
    n = F.col("chapter_num").try_cast("int")
    return records.where(n.isNotNull()).select(pad3(n).alias("chapter_num"), "novel_id")


def metadata_rows(chapters: DataFrame) -> DataFrame:
    """(key, title, time, word_count, desc): keys padded, an empty description gets its placeholder."""
    return chapters.select(pad3(F.col("chapter_num")).alias("key"), "title", "time", "word_count", F.when(F.coalesce("desc", F.lit("")) == "", F.lit(NO_DESCRIPTION)).otherwise(F.col("desc")).alias("desc"))


def summary_line(key: Column, title: Column, time: Column, words: Column, desc: Column) -> Column:
    return F.concat(key, F.lit(" "), title, F.lit(" "), time, F.lit(" 字数: "), words.cast("string"), F.lit("\n"), desc, F.lit("\n\n"))


def summary(metadata: DataFrame, by: str) -> DataFrame:
    """(by, summary): the blocks of each work in numeric order of their keys."""
    line = summary_line(F.col("key"), F.col("title"), F.col("time"), F.col("word_count"), F.col("desc"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("key").try_cast("decimal(38,0)").alias("n"), "key", line.alias("line"))))
    return metadata.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "").alias("summary"))


def metadata_json(metadata: DataFrame, by: str) -> DataFrame:
    """(by, json): the metadata of each work as one JSON object, keys in order."""
    entry = F.struct("key", F.struct("title", "time", "word_count", "desc").alias("v"))
    return metadata.groupBy(by).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("json"))


def from_metadata_json(text: Column) -> Column:
    """map<string, struct<title, time, word_count, desc>>; unreadable text is an empty map."""
    kind = "map<string,struct<title:string,time:string,word_count:bigint,desc:string>>"
    return F.coalesce(F.from_json(text, kind), F.create_map().cast(kind))


def task_numbers(tasks: DataFrame, start: int = 1, selected: bool = False) -> DataFrame:
    """tasks (work_id, pos, ...) with number: the position itself if chapters were selected, else counting from start."""
    if selected:
        return tasks.withColumn("number", F.col("pos").cast("long"))
    return tasks.withColumn("number", F.row_number().over(Window.partitionBy("work_id").orderBy("pos")).cast("long") + (start - 1))


def chapter_selection(text: str | None, total: int) -> list[int]:
    """The positions that "" (all), "n" or "a-b" select out of 1 .. total; ValueError for anything else."""
    import re

    text = (text or "").strip()
    if not text:
        return list(range(1, total + 1))
    m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", text)
    if not m:
        raise ValueError("a selection is a number or a range such as 11-21")
    a = int(m[1])
    b = int(m[2] or a)
    if a > b or a < 1 or b > total:
        raise ValueError(f"a selection lies within 1-{total}, first number first")
    return list(range(a, b + 1))


_REVISIONS = "map<string,struct<msg:string,filename:string,mtime:string,updated_at:string>>"


def revisions_of(texts: DataFrame, by: str) -> DataFrame:
    """(by, key, msg, filename, mtime, updated_at) of texts (by, json); unreadable JSON has no notes."""
    return texts.select(by, F.explode(F.from_json("json", _REVISIONS)).alias("key", "v")).select(by, "key", "v.*")


def set_revisions(old: DataFrame, notes: DataFrame, by: str) -> DataFrame:
    """Notes put in by (by, key), where a note's key is the prefix of its file name, or the whole name; old keys by full name go."""
    new = (notes if "key" in notes.columns else notes.withColumn("key", note_key(F.col("filename")))).select(*old.columns)
    legacy = new.select(by, F.col("filename").alias("key"))
    return upsert(remove(old, legacy, [by, "key"]), new, [by, "key"], F.col("updated_at"))


def note_key(name: Column) -> Column:
    """The key of a note for a full name, a number or a name without one: the leading digits, or else the whole name."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(\d+)", 1), F.lit("")), name)


def noted(notes: DataFrame, files: DataFrame, old: DataFrame, by: str) -> DataFrame:
    """notes (by, filename, msg, updated_at) made ready for set_revisions: filename and mtime of the file that has the note's key.

    files has by, file_name and mtime. A note by number takes the name of the file with that number, the greatest if there are
    several, or none; one by full name keeps it, and the old note's time if there is no such file.
    """
    keyed = notes.withColumn("key", note_key(F.col("filename"))).withColumn("full", F.col("filename") != F.col("key"))
    held = files.withColumn("key", note_key(F.col("file_name"))).groupBy(by, "key").agg(F.max(F.struct("file_name", "mtime")).alias("of_number"), F.map_from_entries(F.collect_set(F.struct("file_name", "mtime"))).alias("by_name"))
    rows = keyed.join(held, [by, "key"], "left").join(old.select(by, "key", F.col("mtime").alias("old_mtime")), [by, "key"], "left")
    name = F.when(F.col("full"), F.col("filename")).otherwise(F.coalesce("of_number.file_name", F.lit("")))
    time = F.when(F.col("full"), F.element_at("by_name", F.col("filename"))).otherwise(F.col("of_number.mtime"))
    return rows.select(by, "key", "msg", name.alias("filename"), F.coalesce(time, "old_mtime", F.lit("")).alias("mtime"), "updated_at")


def remove_revisions(old: DataFrame, names: DataFrame, by: str) -> DataFrame:
    """old without the notes of names (by, filename), each a full name or a number; a note kept under its full name goes if there is none under the number."""
    wanted = names.select(by, note_key(F.col("filename")).alias("key"), "filename").distinct()
    there = wanted.join(old.select(by, "key"), [by, "key"], "left_semi").select(by, "key")
    legacy = wanted.join(old.select(by, "key"), [by, "key"], "left_anti").select(by, F.col("filename").alias("key"))
    return remove(old, there.union(legacy), [by, "key"])


def revisions_json(notes: DataFrame, by: str) -> DataFrame:
    """(by, json): the notes of each work as one JSON object, keys in order."""
    entry = F.struct("key", F.struct("msg", "filename", "mtime", "updated_at").alias("v"))
    return notes.groupBy(by).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("json"))
