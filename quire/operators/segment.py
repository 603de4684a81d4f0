"""Cutting packed volumes into chapters at marker lines, and renumbering them.

The windows run over the lines of one file and the segments of one work; numbering
across files adds per-file counts, so no window spans more than a work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.numerals import EXTRA, NUMERAL, chapter_name, int_to_chinese, marker_columns, renumbered, title_of_file
from quire.functions.text import pad3, sanitize_filename_part, strip, unicode_lines
from quire.operators.running import running

FILE = ["work_id", "file_name"]


def marked_lines(files: DataFrame, limit_title: bool = False) -> DataFrame:
    """(work_id, file_name, file_ord, line_no, line, marker, num, style) of every line of files (work_id, file_name, file_ord, text)."""
    rows = files.select(*FILE, "file_ord", F.posexplode(unicode_lines(F.col("text"))).alias("line_no", "line"))
    return rows.withColumns(marker_columns(F.col("line"), limit_title))


def with_segments(lines: DataFrame) -> DataFrame:
    """lines with seg_no: 0 before the first marker, then counting markers."""
    w = Window.partitionBy(*FILE).orderBy("line_no")
    return lines.withColumn("seg_no", F.count("marker").over(w))


def segments(lines: DataFrame) -> DataFrame:
    """One row for each marker: file_ord, seg_no, marker, num, style and its body lines, joined by line feeds."""
    rows = with_segments(lines).where("seg_no > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("marker").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    return rows.groupBy(*FILE, "file_ord", "seg_no").agg(F.max("marker").alias("marker"), F.max("num").alias("num"), F.max("style").alias("style"), body.alias("body"))


def preambles(lines: DataFrame) -> DataFrame:
    """Non-blank lines before the first marker of a file, stripped: what segmentation leaves out."""
    return with_segments(lines).where("seg_no = 0").select(*FILE, "line_no", strip(F.col("line")).alias("line")).where("line <> ''")


def renumber(segs: DataFrame) -> DataFrame:
    """segs with title, new_num and fixed: within a file numbers count on from the first readable one, in its style."""
    w = Window.partitionBy(*FILE).orderBy("seg_no")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("num", ignorenulls=True).over(whole)
    style = F.first(F.when(F.col("num").isNotNull(), F.col("style")), ignorenulls=True).over(whole)
    counted = segs.withColumn("new_num", F.when(F.col("num").isNotNull(), first + F.count("num").over(w) - 1)).withColumn("first_style", style)
    title = renumbered(F.col("marker"), F.col("num"), F.col("new_num"), F.col("first_style"))
    return counted.withColumn("title", title).withColumn("fixed", F.coalesce(F.col("new_num") != F.col("num"), F.lit(False))).drop("first_style")


def sequenced(segs: DataFrame) -> DataFrame:
    """segs with seq, counting through the files of a work: per-file counts summed, then the place in the file."""
    sizes = segs.groupBy(*FILE, "file_ord").agg(F.count("*").alias("n"))
    ends = running(sizes, ["work_id"], [F.col("file_ord"), F.col("file_name")], {"end": ("sum", F.col("n"))})
    offsets = ends.select(*FILE, (F.col("end") - F.col("n")).alias("offset"))
    return segs.join(offsets, FILE).withColumn("seq", F.col("offset") + F.col("seg_no")).drop("offset")


def volume_ranges(seqs: DataFrame) -> DataFrame:
    """(work_id, file_name, name, start, end): each packed file as a volume over the global sequence."""
    return seqs.groupBy(*FILE).agg(F.min("seq").alias("start"), F.max("seq").alias("end")).withColumn("name", title_of_file(F.col("file_name")))


def chapter_files(seqs: DataFrame, name_only: bool = False) -> DataFrame:
    """(work_id, seq, file_name, title, body): what the segments are written as."""
    shown = chapter_name(F.col("title")) if name_only else F.col("title")
    return seqs.select("work_id", "seq", F.concat(pad3(F.col("seq")), F.lit(" "), sanitize_filename_part(shown), F.lit(".txt")).alias("file_name"), "title", "body")


def split_stats(segs: DataFrame, lines: DataFrame) -> DataFrame:
    """(work_id, chapters, fixed, preamble_files)."""
    left = preambles(lines).select(*FILE).distinct().groupBy("work_id").agg(F.count("*").alias("preamble_files"))
    done = segs.groupBy("work_id").agg(F.count("*").alias("chapters"), F.count_if("fixed").alias("fixed"))
    return done.join(left, "work_id", "left").withColumn("preamble_files", F.coalesce("preamble_files", F.lit(0)))


def display_titles(files: DataFrame, untitled: bool = False) -> DataFrame:
    """files (work_id, file_name, prefix, ord) with kind, number and display: main chapters counted, extras not.

    Only names of digits, white space and .txt take part; number zero is the information page and is left out. With untitled, names
    that begin with digits but are not of this form take part too, as chapters without a title.
    """
    grammar = r"(?id)^(\d+)\s+(.*?)\.txt$"
    formed = F.col("prefix").isNotNull() if untitled else F.col("file_name").rlike(grammar)
    rows = files.where(formed & (F.col("ord") != 0))
    raw = F.regexp_extract("file_name", grammar, 2)
    plain = strip(F.regexp_replace(raw, rf"^第[{NUMERAL.replace('.', '')}]+章\s*", ""))
    rows = rows.withColumn("plain", plain).withColumn("is_extra", F.contains(plain, F.lit(EXTRA)))
    # numbers come from the names alone; texts stay where they are
    names = rows.select("work_id", "ord", "file_name", "is_extra").distinct()
    numbers = running(names, ["work_id"], [F.col("ord"), F.col("file_name")], {"number": ("sum", F.when(F.col("is_extra"), 0).otherwise(1))})
    rows = rows.join(numbers.select("work_id", "file_name", "number"), FILE)
    bare = strip(F.replace(F.replace("plain", F.lit(f"{EXTRA}："), F.lit("")), F.lit(EXTRA), F.lit("")))
    rows = rows.withColumn("number", F.when(~F.col("is_extra"), F.col("number"))).withColumn("bare", bare)
    extra = F.when(F.col("bare") == "", F.lit(EXTRA)).otherwise(F.concat(F.lit(f"{EXTRA}："), F.col("bare")))
    main = F.concat(F.lit("第"), int_to_chinese(F.col("number")), F.lit("章 "), F.col("plain"))
    shown = rows.withColumn("display", F.when(F.col("is_extra"), extra).otherwise(main))
    return shown.drop("plain", "bare").withColumn("new_name", F.concat("prefix", F.lit(" "), "display", F.lit(".txt")))
