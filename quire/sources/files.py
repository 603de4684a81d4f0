"""Chapter folders, index files and landed pages as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import strip, unicode_lines
from quire.operators.overlay import with_keys


def read_chapters(spark: SparkSession, folder: str, work_id: str, rank: int = 0) -> DataFrame:
    """(work_id, layer_rank, file_name, text, mtime, prefix, ord, chapter_key) of the .txt files in a folder, not below it.

    Names come from the path, which the file source leaves unencoded. Names that begin with _ or . are
    invisible to Spark's readers; a missing folder has no files.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return with_keys(spark.createDataFrame([], "work_id string, layer_rank int, file_name string, text string, mtime timestamp"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][xX][tT]").load(folder)
    rows = files.select(
        F.lit(work_id).alias("work_id"), F.lit(rank).alias("layer_rank"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("mtime")
    )
    return with_keys(rows)


def prefix_conflicts(files: DataFrame) -> DataFrame:
    """(work_id, chapter_key, file_names): keys that several files of one layer claim."""
    return files.groupBy("work_id", "layer_rank", "chapter_key").agg(F.array_sort(F.collect_list("file_name")).alias("file_names")).where(F.size("file_names") > 1)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(chapter_num, novel_id) of a CSV without header; rows that do not have exactly two columns are left out."""
    rows = spark.read.schema("chapter_num string, novel_id string, more string").csv(path)
    return rows.where("chapter_num is not null and novel_id is not null and more is null").select("chapter_num", "novel_id")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, title) of a CSV with two or more columns; of a repeated id the last row counts."""
    rows = spark.read.schema("series_id string, title string").csv(path).where("series_id is not null and title is not null").withColumn("pos", F.monotonically_increasing_id())
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("pos")))).where("n = 1").select("series_id", "title")


_VOLUMES = "array<struct<name:string,start:string,end:string>>"


def volumes_of(configs: DataFrame) -> DataFrame:
    """(work_id, pos, name, start, end) of configs (work_id, json); entries whose numbers cannot be read are left out."""
    rows = configs.select("work_id", F.posexplode(F.from_json("json", _VOLUMES)).alias("pos", "v"))
    rows = rows.select("work_id", "pos", strip(F.col("v.name")).alias("name"), F.col("v.start").try_cast("long").alias("start"), F.col("v.end").alias("raw_end"))
    end = F.when(F.col("raw_end").isNull(), F.col("start")).otherwise(F.col("raw_end").try_cast("long"))
    return rows.withColumn("end", end).where("start is not null and end is not null").drop("raw_end")


def key_values(texts: DataFrame, key: str, ascii_first: bool = True) -> DataFrame:
    """(key, line_no, field, value, tail) of texts (key, text): label: value lines; all lines behind 简介 are its tail."""
    rows = texts.select(key, F.posexplode_outer(unicode_lines(F.col("text"))).alias("line_no", "line"))
    at = F.locate(":", F.col("line")) if ascii_first else F.locate("：", F.col("line"))
    other = F.locate("：", F.col("line")) if ascii_first else F.locate(":", F.col("line"))
    pos = F.when(at > 0, at).otherwise(other)
    field = F.when(pos > 0, strip(F.substring(F.col("line"), F.lit(1), pos - 1)))
    rows = rows.withColumn("field", field).withColumn("value", F.when(pos > 0, strip(F.substring(F.col("line"), pos + 1, F.char_length("line")))))
    began = F.min(F.when(F.col("field") == "简介", F.col("line_no"))).over(Window.partitionBy(key))
    return rows.withColumn("tail", F.coalesce(F.col("line_no") > began, F.lit(False)))


def _last(name: str, *labels: str) -> Column:
    return F.max_by("value", F.when(~F.col("tail") & F.col("field").isin(*labels), F.col("line_no"))).alias(name)


def _number(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, "[^0-9]", "").try_cast("long"), F.lit(0))


def series_info(texts: DataFrame, key: str) -> DataFrame:
    """One row for each series information text: title, author, update_time, word_count, chapter_count, tags, description."""
    rows = key_values(texts, key)
    body = F.when(F.col("tail"), strip(F.col("line"))).when(F.col("field") == "简介", F.col("value"))
    lines = F.array_sort(F.collect_list(F.when(body != "", F.struct("line_no", body.alias("t")))))
    found = rows.groupBy(key).agg(_last("title", "系列名称"), _last("author", "作者"), _last("update_time", "更新时间"), _last("words", "总字数"), _last("chapters", "章节数"), _last("labels", "标签"), lines.alias("lines"))
    tags = F.filter(F.transform(F.split(F.replace(F.coalesce("labels", F.lit("")), F.lit("、"), F.lit(",")), ","), strip), lambda t: t != "")
    description = F.when(F.size("lines") > 0, F.array_join(F.transform("lines", lambda x: x["t"]), "\n\n")).otherwise(F.lit("未填"))
    return found.select(
        key, F.coalesce("title", F.lit("未填")).alias("title"), F.coalesce("author", F.lit("未填")).alias("author"), F.coalesce("update_time", F.lit("")).alias("update_time"),
        _number(F.col("words")).alias("word_count"), _number(F.col("chapters")).alias("chapter_count"), tags.alias("tags"), description.alias("description"),
    )


def book_info(texts: DataFrame, key: str) -> DataFrame:
    """One row for each information page: title (its second paragraph), author, platform, status, vol_count, word_count, description."""
    rows = key_values(texts, key, ascii_first=False)
    body = F.when(F.col("tail"), strip(F.col("line"))).when(F.col("field") == "简介", F.col("value"))
    lines = F.array_sort(F.collect_list(F.when(body != "", F.struct("line_no", body.alias("t")))))
    paras = F.array_sort(F.collect_list(F.when(strip(F.col("line")) != "", F.struct("line_no", strip(F.col("line")).alias("t")))))
    found = rows.groupBy(key).agg(
        F.get(F.transform(paras, lambda x: x["t"]), F.lit(1)).alias("title"), _last("author", "作者"), _last("platform", "连载平台", "连载于"), _last("status", "连载状态"), _last("vol_count", "卷/篇数", "卷数", "分卷"), _last("word_count", "字数"), lines.alias("lines")
    )
    text = lambda name, default: F.coalesce(name, F.lit(default)).alias(name)
    description = F.array_join(F.transform("lines", lambda x: x["t"]), "\n")
    return found.select(key, text("title", "未填"), text("author", "未填"), text("platform", ""), text("status", ""), text("vol_count", ""), text("word_count", ""), description.alias("description"))


def illustrations_from_text(texts: DataFrame, key: str, compat: bool = False) -> DataFrame:
    """(key, chapter, pos, img, desc) of illustration texts: a three-digit header sets the chapter, a marker begins an entry.

    ch<digits> in a file name beats the header. compat drops an entry that a header ends and leaves ch numbers unpadded.
    """
    rows = texts.select(key, F.posexplode(unicode_lines(F.regexp_replace("text", "^\\x{feff}", ""))).alias("line_no", "raw")).withColumn("line", strip(F.col("raw"))).where("line <> ''")
    header = F.nullif(F.regexp_extract("line", r"^(\d{3})(?:\s|$)", 1), F.lit(""))
    img = F.nullif(strip(F.regexp_extract("line", r"^【插图[:：]\s*([^】]+)】$", 1)), F.lit(""))
    rows = rows.withColumn("header", header).withColumn("img", F.when(F.col("header").isNull(), img))
    w = Window.partitionBy(key).orderBy("line_no")
    rows = rows.withColumn("under", F.last("header", ignorenulls=True).over(w)).withColumn("entry", F.count("img").over(w)).withColumn("headers", F.count("header").over(w))
    one = Window.partitionBy(key, "entry")
    rows = rows.where("entry > 0").withColumn("own", F.min("headers").over(one)).withColumn("ended", F.max("headers").over(one) > F.col("own"))
    if compat:
        rows = rows.where("not ended")
    rows = rows.where("header is null and headers = own")
    named = F.nullif(F.regexp_extract("img", r"(?i)ch(\d+)", 1), F.lit(""))
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("img").isNull(), F.struct("line_no", "line")))), lambda x: x["line"])
    entries = rows.groupBy(key, "entry").agg(F.max("img").alias("img"), F.min_by("under", "line_no").alias("under"), body.alias("desc")).withColumn("named", named)
    number = F.col("named") if compat else F.lpad(F.col("named").try_cast("bigint").cast("string"), 3, "0")
    long_number = F.when(F.col("named").try_cast("bigint") >= 1000, F.col("named").try_cast("bigint").cast("string")).otherwise(number)
    entries = entries.withColumn("chapter", F.coalesce(long_number if not compat else number, "under")).where("chapter is not null")
    return entries.select(key, "chapter", F.col("entry").alias("pos"), "img", "desc")


def illustrations_from_json(texts: DataFrame, key: str) -> DataFrame:
    """(key, chapter, pos, img, desc) of JSON arrays of {chapter, img, desc}; entries without an image or a chapter are left out."""
    rows = texts.select(key, F.posexplode(F.from_json("text", "array<struct<chapter:string,img:string,desc:string>>")).alias("pos", "e"))
    given = F.col("e.chapter").try_cast("bigint")
    named = F.nullif(F.regexp_extract("e.img", r"(?i)ch(\d+)", 1), F.lit("")).try_cast("bigint")
    number = F.when(F.col("e.chapter").isNotNull(), given).otherwise(named)
    shown = F.when(number >= 1000, number.cast("string")).otherwise(F.lpad(number.cast("string"), 3, "0"))
    desc = F.filter(F.transform(unicode_lines(F.coalesce("e.desc", F.lit(""))), strip), lambda x: x != "")
    return rows.select(key, shown.alias("chapter"), (F.col("pos") + 1).alias("pos"), strip(F.col("e.img")).alias("img"), desc.alias("desc")).where("coalesce(img, '') <> '' and chapter is not null")


def illustrations(texts: DataFrame, key: str, compat: bool = False) -> DataFrame:
    """(key, chapter, pos, img, desc) of illustration files of either form: JSON if a text begins with a bracket and can be read, else text."""
    plain = F.regexp_replace("text", "^\\x{feff}", "")
    form = plain.rlike(r"(?U)^\s*[\[{]") & F.try_parse_json(plain).isNotNull()
    rows = texts.withColumns({"text": plain, "is_json": F.coalesce(form, F.lit(False))})
    return illustrations_from_json(rows.where("is_json"), key).unionByName(illustrations_from_text(rows.where("not is_json"), key, compat))


def first_given(*alternatives: Column) -> Column:
    """The first alternative that is neither null nor empty."""
    return F.coalesce(*[F.nullif(a, F.lit("")) for a in alternatives])


def tag_names(items: Column) -> Column:
    """Names of tag structs (tag, name, translation, userTag), each at its first place."""
    named = F.transform(items, lambda t: strip(first_given(t["tag"], t["name"], t["translation"], t["userTag"])))
    return F.array_distinct(F.filter(named, lambda x: x.isNotNull() & (x != "")))


_LISTING = "struct<body:struct<seriesContents:array<struct<id:string,textCount:bigint,wordCount:bigint>>,page:struct<seriesContents:array<struct<id:string,textCount:bigint,wordCount:bigint>>>>>"


def listing_rows(pages: DataFrame) -> DataFrame:
    """(work_id, page_no, pos, id, words) of landed listing pages (work_id, page_no, json), in either body shape."""
    parsed = pages.withColumn("p", F.from_json("json", _LISTING))
    items = F.coalesce(F.col("p.body.seriesContents"), F.col("p.body.page.seriesContents"))
    rows = parsed.select("work_id", "page_no", F.posexplode(items).alias("pos", "e"))
    return rows.select("work_id", "page_no", "pos", "e.id", F.coalesce(F.nullif("e.textCount", F.lit(0).cast("long")), "e.wordCount", F.lit(0).cast("long")).alias("words"))


_CHAPTER = "struct<error:boolean,body:struct<title:string,content:string,description:string,createDate:string,textCount:bigint>>"


def chapter_details(landed: DataFrame) -> DataFrame:
    """landed (id, json) as (id, ok, title, content, description, time, word_count); a missing count is the content's length."""
    p = landed.withColumn("p", F.from_json("json", _CHAPTER))
    content = F.coalesce("p.body.content", F.lit(""))
    time = F.substring(F.replace(F.coalesce("p.body.createDate", F.lit("")), F.lit("T"), F.lit(" ")), 1, 19)
    return p.select("id", (F.col("p.body").isNotNull() & ~F.coalesce("p.error", F.lit(False))).alias("ok"), F.col("p.body.title").alias("title"), content.alias("content"), F.coalesce("p.body.description", F.lit("")).alias("description"), time.alias("time"), F.coalesce("p.body.textCount", F.char_length(content).cast("long")).alias("word_count"))


def best_candidate(candidates: DataFrame, *by: str) -> DataFrame:
    """Of candidates (by..., path, priority, mtime) the first by priority, then the newest, then by path."""
    w = Window.partitionBy(*by).orderBy("priority", F.col("mtime").desc_nulls_last(), "path")
    return candidates.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def filled_info(*sources: DataFrame) -> DataFrame:
    """(work_id, title, author): of sources in order of trust the first that has a row."""
    ranked = None
    for k, s in enumerate(sources):
        part = s.select("work_id", "title", "author", F.lit(k).alias("rank"))
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.groupBy("work_id").agg(F.min_by(F.struct("title", "author"), "rank").alias("v")).select("work_id", F.coalesce("v.title", F.lit("未填")).alias("title"), F.coalesce("v.author", F.lit("未填")).alias("author"))
