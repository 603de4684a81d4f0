"""Landed responses as tables: what a download does once the pages have been fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import clean_html, page_breaks, sanitize_filename_part
from quire.operators import index
from quire.operators.markup import replace_tags
from quire.sources.files import first_given, tag_names

_TAGS = "array<struct<tag:string,name:string,translation:string,userTag:string>>"
_OVERVIEW = (
    "struct<error:boolean,body:struct<title:string,seriesTitle:string,name:string,userName:string,authorName:string,user:struct<name:string>,"
    f"caption:string,description:string,content:string,updateDate:string,createDate:string,publishedDate:string,tags:{_TAGS},cover:struct<urls:map<string,string>>>>"
)
# Sizes of a cover in order of preference, and extensions that images keep.
COVER_SIZES = ("original", "480mw", "1200x1200", "240x480")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp")


def cover_url(urls: Column) -> Column:
    """The best URL of a map size -> URL; null without any."""
    return first_given(*[F.element_at(urls, F.lit(size)) for size in COVER_SIZES])


def cover_name(url: Column) -> Column:
    """cover and the extension of the URL before its query, .jpg if it is none of an image."""
    ext = F.lower(F.regexp_extract(F.substring_index(url, "?", 1), r"(\.[^./]*)$", 1))
    return F.when(url.isNotNull(), F.concat(F.lit("cover"), F.when(ext.isin(*IMAGE_EXTENSIONS), ext).otherwise(F.lit(".jpg"))))


def series_overview(landed: DataFrame, key: str = "series_id") -> DataFrame:
    """(key, ok, title, author, description, update_time, tags, cover_url, cover) of landed overviews (key, json).

    Of the names that a field has had the first that is neither null nor empty counts. An error or unreadable JSON is not ok
    and has empty fields, for which the caller has others; markup is taken out of the description.
    """
    body = F.col("p.body")
    rows = landed.select(key, F.from_json("json", _OVERVIEW).alias("p"))
    ok = body.isNotNull() & ~F.coalesce("p.error", F.lit(False))
    given = lambda *names: F.coalesce(F.when(ok, first_given(*[body[n] for n in names])), F.lit(""))
    author = F.coalesce(F.when(ok, first_given(body["userName"], body["authorName"], body["user"]["name"])), F.lit(""))
    url = F.when(ok, cover_url(body["cover"]["urls"]))
    return rows.select(
        key, ok.alias("ok"), given("title", "seriesTitle", "name").alias("title"), author.alias("author"), clean_html(given("caption", "description", "content")).alias("description"),
        given("updateDate", "createDate", "publishedDate").alias("update_time"), F.coalesce(F.when(ok, tag_names(body["tags"])), F.array().cast("array<string>")).alias("tags"), url.alias("cover_url"), cover_name(url).alias("cover"),
    )


_DETAIL = "struct<error:boolean,body:struct<title:string,content:string,description:string,createDate:string,textCount:bigint,textEmbeddedImages:map<string,struct<urls:struct<original:string>>>>>"
UNKNOWN_TIME = "未知时间"


def _extension(url: Column) -> Column:
    return F.element_at(F.split(url, "\\."), -1)


def download(details: DataFrame, illustrations: DataFrame | None = None, own_tag: str = "uploadedimage", other_tag: str = "image") -> dict[str, DataFrame]:
    """What landed chapters are written as: chapters, records, metadata, images and failed.

    details has work_id, chapter_num, novel_id and json; illustrations (id, status, url) says of images referenced by
    [other_tag:id] whether they are ok, gone, failed or bad. chapters has work_id, file_name and content, with page breaks as
    blank lines and markers in place of image tags; images (work_id, img, url) are those to be fetched; metadata
    (work_id, key, title, time, word_count, desc) and records (work_id, chapter_num, novel_id) are for the upserts; failed
    has work_id, chapter_num and novel_id of responses with an error or without a body.
    """
    keys = ["work_id", "chapter_num", "novel_id"]
    rows = details.select(*keys, F.from_json("json", _DETAIL).alias("p"))
    ok = F.col("p.body").isNotNull() & ~F.coalesce("p.error", F.lit(False))
    good = rows.where(ok).select(*keys, "p.body.*")
    own = good.select(*keys, F.explode("textEmbeddedImages").alias("id", "v")).select(*keys, "id", F.col("v.urls.original").alias("url"))
    own = own.withColumn("img", F.concat(F.lit("ch"), "chapter_num", F.lit("_up_"), "id", F.lit("."), _extension(F.col("url")))).where("url is not null")
    texts = good.select(*keys, page_breaks(F.coalesce("content", F.lit(""))).alias("text"))
    texts = _swapped(texts, own.select(*keys, "id", F.lit("ok").alias("status"), "img"), own_tag, keys)
    wanted = own.select("work_id", "img", "url")
    if illustrations is not None:
        ids = texts.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"\[{other_tag}:(\d+)\]"), 1))).alias("id"))
        met = ids.join(illustrations.select("id", "status", "url"), "id").withColumn("img", F.concat(F.lit("ch"), "chapter_num", F.lit("_pid_"), "id", F.lit("."), _extension(F.col("url"))))
        wanted = wanted.unionByName(met.where("status = 'ok'").select("work_id", "img", "url"))
        texts = _swapped(texts, met.select(*keys, "id", "status", "img"), other_tag, keys)
    time = F.coalesce(F.substring(F.replace("createDate", F.lit("T"), F.lit(" ")), 1, 19), F.lit(UNKNOWN_TIME))
    about = good.select("work_id", "chapter_num", "title", time.alias("time"), F.coalesce("textCount", F.char_length(F.coalesce("content", F.lit(""))).cast("long")).alias("word_count"), clean_html(F.col("description")).alias("desc"))
    named = texts.join(good.select(*keys, "title"), keys)
    return {
        "chapters": named.select("work_id", F.concat("chapter_num", F.lit(" "), sanitize_filename_part(F.coalesce("title", F.lit(""))), F.lit(".txt")).alias("file_name"), F.col("text").alias("content")),
        "records": good.select(*keys),
        "metadata": about.select("work_id", *_metadata_columns()),
        "images": wanted.distinct(),
        "failed": rows.where(~ok).select(*keys),
    }


def _metadata_columns() -> list[Column]:
    number = F.col("chapter_num").try_cast("int")
    key = F.when(number.isNull(), F.col("chapter_num")).when(number >= 1000, number.cast("string")).otherwise(F.lpad(number.cast("string"), 3, "0"))
    return [key.alias("key"), F.col("title"), F.col("time"), F.col("word_count"), F.when(F.col("desc") == "", F.lit(index.NO_DESCRIPTION)).otherwise(F.col("desc")).alias("desc")]


def _swapped(texts: DataFrame, images: DataFrame, tag: str, keys: list[str]) -> DataFrame:
    """texts with the tags of their own images replaced: an id means what the same chapter's row says."""
    one = F.concat_ws("\x1f", *keys)
    local = images.select(F.concat_ws("\x1f", one, F.col("id")).alias("id"), "status", "img")
    return replace_tags(texts, local, tag, keys, scope=one)


def work_paths(scope: str, target: Column) -> dict[str, Column]:
    """Where the files of a single work (novel) or a series lie, below the output folder."""
    folder = F.concat(F.lit(f"{scope}_"), target.cast("string"))
    inside = lambda name: F.concat(folder, F.lit("/"), F.lit(f"{scope}_"), target.cast("string"), F.lit(name))
    return {
        "folder": folder, "chapters": F.concat(folder, F.lit("/chapters")), "images": F.concat(folder, F.lit("/illustrations")), "records": inside("_records.csv"), "metadata": inside("_metadata.json"),
        "summary": inside("_summary.txt"), "info": inside("_info.txt"), "cover": F.concat(folder, F.lit("/cover.jpg")),
    }


def search_places(folders: DataFrame, below: list[str], own: bool = True, parents: int = 1) -> DataFrame:
    """(work_id, place, priority): where a file is looked for, given the layers' folders (work_id, rank, folder).

    Higher ranks come first, a folder before its parent, the subfolders in the given order ("" for the folder itself);
    a place that comes twice keeps its first priority.
    """
    up = [F.regexp_replace("folder", rf"(?:/[^/]*){{{k}}}$", "") for k in range(0 if own else 1, parents + 1)]
    bases = F.array(*[F.struct(F.lit(k).alias("k"), p.alias("base")) for k, p in enumerate(up)])
    rows = folders.select("work_id", "rank", F.explode(bases).alias("b")).where("b.base <> ''")
    subs = F.array(*[F.struct(F.lit(k).alias("s"), F.lit(x).alias("sub")) for k, x in enumerate(below)])
    rows = rows.withColumn("sub", F.explode(subs))
    place = F.when(F.col("sub.sub") == "", F.col("b.base")).otherwise(F.concat_ws("/", "b.base", "sub.sub"))
    return rows.groupBy("work_id", place.alias("place")).agg(F.min(F.struct((-F.col("rank")).alias("r"), F.col("b.k").alias("k"), F.col("sub.s").alias("s"))).alias("priority"))


def found_files(places: DataFrame, files: DataFrame, names: Column) -> DataFrame:
    """(work_id, path): of files (work_id, folder, name) whose name satisfies ``names`` the one in the first place, then by name."""
    met = files.where(names).join(places, (files.work_id == places.work_id) & (files.folder == places.place)).select(files.work_id, "priority", "folder", "name")
    return met.groupBy("work_id").agg(F.min_by(F.concat_ws("/", "folder", "name"), F.struct("priority", "name")).alias("path"))


def cover_files(name: Column) -> Column:
    """Names of covers."""
    return F.lower(name).rlike(r"^(?:cover|封面)\.(?:jpg|jpeg|png|gif|webp)$")
