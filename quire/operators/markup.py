"""Illustrations and image tags in chapter texts: lookups joined to the text they stand in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import escape_html, strip

# Fixed value: how an illustration is marked in a text.
ILLUSTRATION = r"【插图[:：]\s*([^】]+)】"


def image_markers(paras: DataFrame) -> DataFrame:
    """paras (keys..., line_no, text) with one row for each marker: n and img."""
    found = F.transform(F.regexp_extract_all("text", F.lit(ILLUSTRATION), 1), strip)
    return paras.select("*", F.posexplode(found).alias("n", "img"))


def found_images(paras: DataFrame, images: DataFrame) -> DataFrame:
    """Markers with path, null where no image of that name exists; among images of one name the least priority wins."""
    best = images.groupBy("img").agg(F.min_by("path", F.struct("priority", "path")).alias("path"))
    return image_markers(paras).join(best, "img", "left")


def replace_tags(texts: DataFrame, images: DataFrame, tag: str, key: list[str], scope: Column | None = None) -> DataFrame:
    """texts (key..., text) with every [tag:id] replaced by what images (id, status, img) say of it.

    status ok gives the illustration's marker, gone, failed and bad each its notice; an id without a row stays
    as it is. With scope, ids in images are those of a text behind its scope and a unit separator. Only the distinct ids of a text are joined, so a text is shuffled once whatever it holds.
    """
    mark = lambda body: F.concat(F.lit("\n\n【"), body, F.lit("】\n\n"))
    notice = (
        F.when(F.col("status") == "ok", mark(F.concat(F.lit("插图: "), F.col("img"))))
        .when(F.col("status") == "gone", mark(F.concat(F.lit("插图失效: 原图 "), F.col("shown_id"), F.lit(" 已删除"))))
        .when(F.col("status") == "failed", mark(F.concat(F.lit("插图获取失败: 原图 "), F.col("shown_id"), F.lit(" 请求超时或网络异常"))))
        .when(F.col("status") == "bad", mark(F.concat(F.lit("插图获取失败: 原图 "), F.col("shown_id"), F.lit(" 返回数据异常"))))
    )
    ids = texts.select(*key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(rf"\[{tag}:(\d+)\]"), 1))).alias("id"))
    shown = F.col("shown_id")
    if scope is not None:
        ids = ids.withColumn("id", F.concat_ws("\x1f", scope, "id"))
    known = ids.join(images.select("id", F.element_at(F.split("id", "\x1f"), -1).alias("shown_id"), "status", "img").select("id", "shown_id", notice.alias("to")), "id").where("to is not null").select(*key, shown.alias("id"), "to")
    pairs = known.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("id", "to"))).alias("pairs"))
    swapped = F.aggregate("pairs", F.col("text"), lambda acc, p: F.replace(acc, F.concat(F.lit(f"[{tag}:"), p["id"], F.lit("]")), p["to"]))
    return texts.join(pairs, key, "left").withColumn("text", F.when(F.col("pairs").isNull(), F.col("text")).otherwise(swapped)).drop("pairs")


def paragraph_html(text: Column) -> Column:
    # looking for a character costs a fraction of replacing it, and most paragraphs have none of these
    special = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in "&<>\"'"])
    return F.concat(F.lit("<p>"), F.when(special, escape_html(text)).otherwise(text), F.lit("</p>"))


def image_html(img: Column, desc: Column) -> Column:
    """The fragment of an illustration; desc is an array of lines, which may be empty or null."""
    lines = F.array_join(F.transform(desc, escape_html), "<br/>")
    note = F.when(F.size(F.coalesce(desc, F.array().cast("array<string>"))) > 0, F.concat(F.lit('<div class="illustration-desc">'), lines, F.lit("</div>"))).otherwise(F.lit(""))
    return F.concat(F.lit('<div class="illustration"><img src="img/'), escape_html(img), F.lit('" alt="插图"/>'), note, F.lit("</div>"))


def inline_fragments(para: Column, known: Column) -> Column:
    """array<string>: the fragments of a paragraph, its markers of known images as illustrations in their places; other markers stay text."""
    texts, marks = F.split(para, ILLUSTRATION), F.regexp_extract_all(para, F.lit(ILLUSTRATION), 0)
    names = F.transform(F.regexp_extract_all(para, F.lit(ILLUSTRATION), 1), strip)
    none = F.array().cast("array<string>")
    flush = lambda out, buf: F.when(buf != "", F.concat(out, F.array(paragraph_html(strip(buf))))).otherwise(out)

    def step(acc: Column, i: Column) -> Column:
        text, mark, name = F.get(texts, i), F.get(marks, i), F.get(names, i)
        buf = F.when(strip(text) != "", F.concat(acc["buf"], text)).otherwise(acc["buf"])
        shown = F.coalesce(F.array_contains(known, name), F.lit(False))
        image = F.when(shown, F.array(image_html(name, none))).otherwise(none)
        return F.struct(F.when(shown | mark.isNull(), F.concat(flush(acc["out"], buf), image)).otherwise(acc["out"]).alias("out"), F.when(shown, F.lit("")).otherwise(F.concat(buf, F.coalesce(mark, F.lit("")))).alias("buf"))

    start = F.struct(none.alias("out"), F.lit("").alias("buf"))
    whole = F.aggregate(F.sequence(F.lit(0), F.size(marks)), start, step, lambda acc: acc["out"])
    return F.when(para.rlike(ILLUSTRATION), whole).otherwise(F.array(paragraph_html(para)))


def with_illustrations(bodies: DataFrame, illustrations: DataFrame, key: list[str]) -> DataFrame:
    """bodies (key..., fragments array) with the fragments of illustrations (key..., pos, img, desc) behind them, in their order."""
    extra = illustrations.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "img", "desc"))), lambda x: image_html(x["img"], x["desc"])).alias("extra"))
    return bodies.join(extra, key, "left").withColumn("fragments", F.concat("fragments", F.coalesce("extra", F.array().cast("array<string>")))).drop("extra")
