"""Views over the driver's tables that exercise the operators, in Spark and as DuckDB SQL.

The raw tables hold no markers, extras or odd white space, so these are put in by
the same expressions on both sides. All rows of a table take part, but for layers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import LINE_BREAK, STRIP, pad3
from quire.operators.overlay import with_keys

WORK_SIZE = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with ideographic spaces, tabs and no-break spaces about lines, and a blank line at the end."""
    text = F.concat(F.lit("　"), F.replace("text", F.lit("\n"), F.lit("\t\n ")), F.lit("\n 　\n"))
    return documents(spark, sf_dir).withColumn("text", text)


def quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with straight quotes, question and exclamation marks."""
    text = F.replace(F.replace("text", F.lit(", "), F.lit(' "')), F.lit(". "), F.lit('?" Oh! '))
    return documents(spark, sf_dir).withColumn("text", text)


def work(key: str = "doc_id"):
    return F.expr(f"{key} div {WORK_SIZE}")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chapter files: twenty to a work, some extras, some without a number."""
    n = F.col("doc_id") % WORK_SIZE
    title = F.concat(F.when(F.col("doc_id") % 6 == 0, F.lit("番外：")).otherwise(F.lit("")), F.regexp_replace(F.substring("text", 1, 10), "[\n.]", ""), F.lit(".txt"))
    name = F.when(F.col("doc_id") % 19 == 0, title).otherwise(F.concat(pad3(n), F.lit(" "), title))
    return with_keys(documents(spark, sf_dir).select("doc_id", work().alias("work_id"), name.alias("file_name"), "text"))


def layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Three layers of one collection, keyed by doc_id: base, corrected and extra; each lacks a few of the documents and holds the whole texts of all others."""
    d = documents(spark, sf_dir)
    if name == "base":
        d = d.where("doc_id % 11 <> 0")
    elif name == "corrected":
        d = d.where("doc_id % 13 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("en"), F.lit("EN"))).otherwise(F.col("text")))
    else:
        d = d.where("doc_id % 17 <> 0").withColumn("text", F.upper("text"))
    key = F.col("doc_id").cast("string")
    tail = F.lit(".txt") if name == "base" else F.lit(" extra.txt") if name == "extra" else F.when(F.col("doc_id") % 4 == 0, F.lit(" v2.txt")).otherwise(F.lit(".txt"))
    return d.select(work().alias("work_id"), key.alias("chapter_key"), F.concat(key, tail).alias("file_name"), "text")


def conflicting(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """All documents as chapter files of works of forty, in which ``size`` neighbours share a prefix."""
    n = F.expr(f"doc_id % 40 div {size}")
    return with_keys(documents(spark, sf_dir).select(F.expr("doc_id div 40").alias("work_id"), F.concat(pad3(n), F.lit(" t"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt")).alias("file_name"), "text"))


def marked(spark: SparkSession, sf_dir: str, quotes: bool = False) -> DataFrame:
    """(work_id, file_name, file_ord, text): documents as packed files whose lines hold markers of several kinds; with quotes in other lines, if wanted."""
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    s, n = F.col("doc_id") + F.col("line_no"), (F.col("line_no") * 7) % 13 + 1
    title = F.substring("line", 1, 8)
    number = F.when(s % 3 == 0, F.element_at(F.array(*[F.lit(x) for x in "一 二 三 四 五 六 七 八 九 十 十一 十二 十三".split()]), n.cast("int"))).otherwise(n.cast("string"))
    gap = F.when(F.col("line_no") % 3 == 0, F.lit("")).otherwise(F.lit(" "))
    stop = F.when(F.col("line_no") % 4 == 0, F.lit("。")).otherwise(F.lit(""))
    line = F.when(s % 17 == 3, F.lit("番外：x")).when(s % 5 == 2, F.concat(F.lit("第"), number, F.lit("章"), gap, title, stop)).otherwise(F.replace("line", F.lit(", "), F.lit(' "')) if quotes else F.col("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("l")))), lambda x: x["l"]), "\n")
    files = rows.groupBy("doc_id").agg(joined.alias("text"))
    return files.select(work().alias("work_id"), F.col("doc_id").cast("string").alias("file_name"), F.col("doc_id").alias("file_ord"), "text")


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, chapter_key, ord): documents as numbered chapters without their texts."""
    n = F.col("doc_id") % WORK_SIZE
    return table(spark, sf_dir, "documents").select(work().alias("work_id"), pad3(n).alias("chapter_key"), n.alias("ord"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(work_id, pos, name, start, end): five volumes for each work, two of them overlapping, one empty."""
    each = F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(f"第{c}卷 V{k}").alias("name"), F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for k, (c, a, b) in enumerate([("一", 1, 6), ("二", 7, 12), ("三", 12, 14), ("四", 13, 15), ("五", 90, 95)])])
    works = table(spark, sf_dir, "documents").select(work().alias("work_id")).distinct()
    return works.select("work_id", F.explode(each).alias("v")).select("work_id", "v.*")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


# --- the same for DuckDB ---------------------------------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {q(STRIP)}, '', 'g')"


def paragraphs_sql(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, {q(LINE_BREAK)}), lambda p: {strip_sql('p')}), lambda p: p <> '')"


LF = "chr(10)"
SPACED = f"SELECT doc_id, lang, chr(12288) || replace(text, {LF}, chr(9) || {LF} || chr(160)) || {LF} || ' ' || chr(12288) || {LF} AS text FROM documents"
QUOTED = "SELECT doc_id, lang, replace(replace(text, ', ', ' \"'), '. ', '?\" Oh! ') AS text FROM documents"
WORK = f"(doc_id // {WORK_SIZE})"
PAD = "lpad(CAST(doc_id % 20 AS VARCHAR), 3, '0')"
CHAPTERS = f"""SELECT *, nullif(regexp_extract(file_name, '^(\\d+)', 1), '') AS prefix, coalesce(nullif(regexp_extract(file_name, '^(\\d+)', 1), ''), file_name) AS chapter_key FROM (
SELECT doc_id, {WORK} AS work_id, CASE WHEN doc_id % 19 = 0 THEN '' ELSE {PAD} || ' ' END || CASE WHEN doc_id % 6 = 0 THEN '番外：' ELSE '' END || regexp_replace(substr(text, 1, 10), '[\\n.]', '', 'g') || '.txt' AS file_name, text FROM documents)"""
LAYERS = {
    "base": f"SELECT {WORK} AS work_id, CAST(doc_id AS VARCHAR) AS chapter_key, doc_id || '.txt' AS file_name, text FROM documents WHERE doc_id % 11 <> 0",
    "corrected": f"SELECT {WORK} AS work_id, CAST(doc_id AS VARCHAR) AS chapter_key, doc_id || CASE WHEN doc_id % 4 = 0 THEN ' v2.txt' ELSE '.txt' END AS file_name, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'en', 'EN') ELSE text END AS text FROM documents WHERE doc_id % 13 <> 0",
    "extra": f"SELECT {WORK} AS work_id, CAST(doc_id AS VARCHAR) AS chapter_key, doc_id || ' extra.txt' AS file_name, upper(replace(text, 'ß', 'SS')) AS text FROM documents WHERE doc_id % 17 <> 0",
}


def conflicting_sql(size: int) -> str:
    return f"SELECT *, substr(file_name, 1, 3) AS chapter_key FROM (SELECT doc_id // 40 AS work_id, lpad(CAST(doc_id % 40 // {size} AS VARCHAR), 3, '0') || ' t' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.txt' AS file_name, text FROM documents)"


NUMBERED = f"SELECT {WORK} AS work_id, {PAD} AS chapter_key, doc_id % 20 AS ord FROM documents"
VOLUMES = f"SELECT work_id, pos, name, start, \"end\", pos + 1 AS vol_no FROM (SELECT DISTINCT {WORK} AS work_id FROM documents), (VALUES (0, '第一卷 V0', 1, 6), (1, '第二卷 V1', 7, 12), (2, '第三卷 V2', 12, 14), (3, '第四卷 V3', 13, 15), (4, '第五卷 V4', 90, 95)) v(pos, name, start, \"end\")"
#: Lines with markers: (doc_id, line_no, line), line_no from 0.
MARKED_LINES = f"""SELECT doc_id, line_no, CASE WHEN (doc_id + line_no) % 17 = 3 THEN '番外：x' WHEN (doc_id + line_no) % 5 = 2 THEN '第' ||
CASE WHEN (doc_id + line_no) % 3 = 0 THEN ['一','二','三','四','五','六','七','八','九','十','十一','十二','十三'][CAST((line_no * 7) % 13 + 1 AS INTEGER)] ELSE CAST((line_no * 7) % 13 + 1 AS VARCHAR) END
|| '章' || CASE WHEN line_no % 3 = 0 THEN '' ELSE ' ' END || substr(line, 1, 8) || CASE WHEN line_no % 4 = 0 THEN '。' ELSE '' END ELSE line END AS line
FROM (SELECT doc_id, unnest(string_split(text, {LF})) AS line, unnest(range(len(string_split(text, {LF})))) AS line_no FROM documents)"""
NUMERALS = "['一','二','三','四','五','六','七','八','九','十','十一','十二','十三']"
#: The same with quotes in the lines that are no markers.
QUOTED_LINES = MARKED_LINES.replace("ELSE line END AS line", "ELSE replace(line, ', ', ' \"') END AS line")
#: Markers of these lines: num null for extras.
MARKERS = f"""SELECT doc_id, line_no, s AS marker, CASE WHEN s LIKE '第%' THEN coalesce(try_cast(n AS BIGINT), CAST(list_position({NUMERALS}, n) AS BIGINT)) END AS num,
CASE WHEN s LIKE '番外%' THEN 'extra' WHEN try_cast(n AS BIGINT) IS NOT NULL THEN 'arabic' ELSE 'chinese' END AS style, rest FROM (
SELECT doc_id, line_no, s, regexp_extract(s, '^第([一二三四五六七八九十百千万零两0-9.]+)[章话节回]', 1) AS n, regexp_replace(s, '^第[一二三四五六七八九十百千万零两0-9.]+[章话节回]', '') AS rest FROM (SELECT doc_id, line_no, {strip_sql('line')} AS s FROM ({MARKED_LINES})))
WHERE length(s) <= 40 AND s <> '' AND ((n <> '' AND NOT (rest <> '' AND NOT regexp_matches(rest, '^[\\s：:]') AND contains(s, '。'))) OR regexp_matches(s, '^番外([：:].*)?$'))"""
