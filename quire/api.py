"""The commands of the toolkit as functions over tables; each returns the DataFrames that its files are written from.

A chapter table has work_id, file_name, text, prefix, ord and chapter_key, as
``sources.files.read_chapters`` gives it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.numerals import EXTRA
from quire.functions.text import char_count, chinese_date, convert_punctuation, interleave_blank_lines, once, pad3, paragraphs, punctuation_stats
from quire.operators import diff, index, markup, overlay, publish, reports, segment, volumes
from quire.operators.running import running
from quire.sources import config, files, landed


def merge(*layers: DataFrame, ranges: DataFrame | None = None, indent: bool = False, info: bool = False, in_chunks: bool = False) -> DataFrame:
    """(work_id, text): the layers overlaid, later ones winning, as one text; ranges are valid volumes.

    The information page (000) stands first; with info its counts are renewed from the chapters that are merged. in_chunks
    gives (work_id, chunk_no, offset, text) for works of any length.
    """
    done = overlay.with_keys(overlay.overlay(*layers)).where(~overlay.is_reserved(F.col("file_name")))
    heads = volumes.headings(done, ranges) if ranges is not None else None
    make = publish.merge_chunks if in_chunks else publish.merge_text
    return make(refreshed(done, ranges) if info else done, heads, indent)


def refreshed(chapters: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """chapters with the counts on information pages renewed: characters, main and extra chapters, volumes."""
    told = overlay.is_chapter(F.col("file_name"))
    extra = F.contains(F.col("file_name"), F.lit(EXTRA))
    counts = chapters.groupBy("work_id").agg(F.sum(F.when(told, char_count(F.col("text"))).otherwise(0)).alias("words"), F.count_if(told & ~extra).alias("main"), F.count_if(told & extra).alias("extra"))
    n = ranges.groupBy("work_id").agg(F.count("*").alias("n_volumes")) if ranges is not None else chapters.select("work_id", F.lit(0).cast("long").alias("n_volumes")).where("false")
    rows = chapters.join(counts, "work_id").join(n, "work_id", "left")
    page = publish.refresh_info(F.col("text"), F.col("words"), F.col("main"), F.col("extra"), F.coalesce("n_volumes", F.lit(0)))
    return rows.withColumn("text", F.when(F.col("file_name").startswith("000 "), page).otherwise(F.col("text"))).select(*chapters.columns)


def book_info(chapters: DataFrame, about: DataFrame | None = None) -> DataFrame:
    """(work_id, file_name, text): the information page of each work.

    about has work_id, title, author, platform, update_time, words and description, as series pages and metadata give them; a
    work without a row there gets the blank page. Main and extra chapters are counted by file name.
    """
    works = chapters.groupBy("work_id").agg(F.count_if(overlay.is_chapter(F.col("file_name")) & ~F.contains(F.col("file_name"), F.lit(EXTRA))).alias("main"), F.count_if(overlay.is_chapter(F.col("file_name")) & F.contains(F.col("file_name"), F.lit(EXTRA))).alias("extra"))
    blank = F.lit(publish.blank_info_page())
    if about is None:
        return works.select("work_id", F.lit(publish.INFO_NAME).alias("file_name"), blank.alias("text"))
    rows = works.join(about.withColumn("known", F.lit(True)), "work_id", "left")
    page = publish.info_page(F.col("title"), F.col("author"), F.col("platform"), F.col("main"), F.col("extra"), chinese_date(F.col("update_time")), F.col("words"), F.col("description"))
    return rows.select("work_id", F.lit(publish.INFO_NAME).alias("file_name"), F.when(F.col("known"), page).otherwise(blank).alias("text"))


def format_chapters(chapters: DataFrame, punct: bool = False) -> DataFrame:
    """(work_id, file_name, text): chapters renamed by their running number, the title put in, a blank line behind each paragraph."""
    titled = segment.display_titles(chapters)
    body = paragraphs(F.col("text"))
    if punct:
        body = F.transform(body, lambda p: convert_punctuation(p))
    return titled.select("work_id", F.col("new_name").alias("file_name"), publish.chapter_text(F.col("display"), body).alias("text"))


def format_single(texts: DataFrame) -> DataFrame:
    """texts with a blank line between paragraphs."""
    return texts.withColumn("text", interleave_blank_lines(paragraphs(F.col("text"))))


def punct(texts: DataFrame, scope: str = "file") -> DataFrame:
    """texts with full-width punctuation and the counts of what was changed."""
    stats = {n: c for n, c in punctuation_stats(F.col("text")).items()}
    return texts.withColumns(stats).withColumn("text", convert_punctuation(F.col("text"), scope))


def compare_files(files: DataFrame) -> DataFrame:
    """files (..., text1, text2) with the report of their comparison."""
    return reports.comparison_text(files)


def note_add(old: DataFrame, notes: DataFrame, files: DataFrame, by: str) -> DataFrame:
    """old with notes (by, filename, msg, updated_at) put in, by full name or number; files has by, file_name and mtime."""
    return index.set_revisions(old, index.noted(notes, files, old, by), by)


def note_list(old: DataFrame, by: str) -> DataFrame:
    """(by, text): a line for each note in the order of keys."""
    line = F.concat(F.lit("["), "key", F.lit("] "), "filename", F.lit(": "), "msg")
    rows = F.array_sort(F.collect_list(F.struct("key", line.alias("line"))))
    return old.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def note_remove(old: DataFrame, names: DataFrame, by: str) -> DataFrame:
    """old without the notes of names (by, filename)."""
    return index.remove_revisions(old, names, by)


def note_clear(old: DataFrame, works: DataFrame, by: str) -> DataFrame:
    """old without any note of works."""
    return old.join(works.select(by), by, "left_anti")


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """The paragraphs in which chapters of equal key differ."""
    return diff.paragraph_diffs(diff.compare(first, second))


def diff_layers(base: DataFrame, corrected: DataFrame, preview: int = 3, in_chunks: bool = False) -> dict[str, DataFrame]:
    """summary, chapters, preview and report of two layers; in_chunks gives the report as (work_id, chunk_no, offset, text)."""
    found = diff.compare(base, corrected)
    return {"summary": diff.status_summary(found), "chapters": found, "preview": diff.preview(diff.paragraph_diffs(found), preview), "report": (reports.report_chunks if in_chunks else reports.directory_report)(found, preview)}


def assemble(base: DataFrame, corrected: DataFrame, in_chunks: bool = False) -> dict[str, DataFrame]:
    """chapters, summary and lineage of a corrected layer over a base; in_chunks gives the lineage as (work_id, chunk_no, offset, text)."""
    done = overlay.assemble(base, corrected)
    return {"chapters": done, "summary": overlay.assemble_summary(done), "lineage": (overlay.lineage_chunks if in_chunks else overlay.lineage_lines)(done)}


def split(packed: DataFrame, name_only: bool = False, limit_title: bool = False, punct: bool = False) -> dict[str, DataFrame]:
    """chapters, volumes (JSON) and stats of packed files (work_id, file_name, file_ord, text).

    Punctuation is converted chapter by chapter, title included, so an open quote ends with its chapter; file names keep theirs.
    """
    lines = segment.marked_lines(packed, limit_title)
    segs = segment.renumber(segment.segments(lines))
    seqs = segment.sequenced(segs)
    chapters = segment.chapter_files(seqs, name_only)
    if punct:
        whole = once(chapters, whole=convert_punctuation(F.concat("title", F.lit("\n"), F.coalesce("body", F.lit("")))))
        chapters = whole.withColumns({"title": F.substring_index("whole", "\n", 1), "body": F.substring(F.col("whole"), F.char_length("title") + 2, F.char_length("whole"))}).select(*chapters.columns)
    return {"chapters": chapters, "volumes": volumes.volumes_json(segment.volume_ranges(seqs)), "stats": segment.split_stats(segs, lines)}


def epub(
    *layers: DataFrame, ranges: DataFrame, info: DataFrame | None = None, styles: str | None = None, title_style: str | None = None, vol_style: str | None = None, modified: str, images: DataFrame | None = None, illustrations: DataFrame | None = None, covers: DataFrame | None = None, in_parts: bool = False
) -> DataFrame:
    """(work_id, file_name, content): an e-book of each work; info has work_id, title and author, which beat those of its information page.

    in_parts gives its bytes as rows with part_no and offset, none larger than a page or an image, for ``sink.write_parts``.

    A work with an information page (000) has it in front, its counts renewed from the chapters that are packed.

    images (work_id, img, priority, content) are shown where a text has their marker, and at the end of the chapters that
    illustrations (work_id, chapter, pos, img, desc array) name; covers has work_id, img and content.
    """
    if illustrations is not None and images is None:
        raise ValueError("illustrations need images")
    presets = config.parse_styles(styles)
    chapter, volume = config.resolve_style(presets["chapter"], title_style, config.CHAPTER_STYLE), config.resolve_style(presets["volume"], vol_style, config.VOLUME_STYLE)
    whole = overlay.with_keys(overlay.overlay(*layers)).where(~overlay.is_reserved(F.col("file_name")))
    own = files.book_info(refreshed(whole, ranges).where(F.col("file_name").startswith("000 ")).select("work_id", "text"), "work_id")
    about = own if info is None else own.join(info.select("work_id", F.col("title").alias("_t"), F.col("author").alias("_a")), "work_id", "left").withColumns({"title": F.coalesce("_t", "title"), "author": F.coalesce("_a", "author")}).drop("_t", "_a")
    named = about.select("work_id", "title", "author")
    if info is not None:
        named = named.unionByName(info.select("work_id", "title", "author").join(named.select("work_id"), "work_id", "left_anti"))
    done = whole.where(overlay.is_chapter(F.col("file_name")))
    chapters, found = done.withColumn("file_title", segment.title_of_file(F.col("file_name"))), None
    if images is None:
        titled = publish.resolved_titles(chapters)
    else:
        found = publish.known_images(images)
        names = found.groupBy("work_id").agg(F.array_sort(F.collect_list("img")).alias("known"))
        titled = publish.resolved_titles(chapters.join(names, "work_id", "left"), F.coalesce("known", F.array().cast("array<string>")))
    if illustrations is not None:
        notes = illustrations.join(found.select("work_id", "img"), ["work_id", "img"], "left_semi").withColumnRenamed("chapter", "chapter_key")
        titled = markup.with_illustrations(titled, notes, overlay.KEY)
    items = volumes.spine(done, ranges).join(titled.select("work_id", "chapter_key", "display_title", "fragments"), overlay.KEY, "left")
    pages = publish.page_rows(items.withColumn("title", F.coalesce("display_title", "title")), chapter, volume)
    pages = pages.unionByName(publish.info_pages(about).select(*[F.col(c).cast(pages.schema[c].dataType).alias(c) for c in pages.columns]))
    make = publish.book_parts if in_parts else publish.books
    return make(pages, named, publish.style_sheet(chapter, volume), modified, found, covers)


def import_tasks(tasks: DataFrame, chapters: DataFrame, force: bool = False) -> DataFrame:
    """Tasks (chapter_num, novel_id) of an import list that are still to be done: those without a file, or all if forced; numbers as written."""
    have = chapters.select(pad3(F.col("prefix").try_cast("int")).alias("chapter_num")).where("chapter_num is not null")
    return overlay.pending(index.record_rows(tasks), have, "chapter_num", force)


def retry(records: DataFrame, chapters: DataFrame) -> DataFrame:
    """Records whose chapter has no file; a prefix counts as its number, so 1 and 001 are the same chapter."""
    have = chapters.select(pad3(F.col("prefix").try_cast("int")).alias("chapter_num")).where("chapter_num is not null")
    return overlay.missing(index.record_rows(records), have, "chapter_num")


def selected(tasks: DataFrame, selection: DataFrame | None) -> DataFrame:
    """tasks (work_id, pos, ...) that a selection (work_id, wanted) keeps: wanted is empty or null (all), a number, or a range such as 11-21.

    A work without a row keeps all, one whose selection is none of these, or does not lie within 1 and its number of tasks first
    number first, keeps nothing and is for the caller to report (``odd_selections``).
    """
    if selection is None:
        return tasks
    met = tasks.join(_ranges_wanted(tasks, selection), "work_id", "left")
    return met.where(F.col("all").isNull() | F.col("all") | (F.col("valid") & F.col("pos").between(F.col("low"), F.col("high")))).select(*tasks.columns)


def odd_selections(tasks: DataFrame, selection: DataFrame) -> DataFrame:
    """(work_id, wanted) of selections that keep nothing because they are none."""
    return _ranges_wanted(tasks, selection).where(~F.col("all") & ~F.col("valid")).select("work_id", "wanted")


def _ranges_wanted(tasks: DataFrame, selection: DataFrame) -> DataFrame:
    grammar = r"^(\d+)(?:\s*-\s*(\d+))?$"
    wanted = F.trim(F.coalesce("wanted", F.lit("")))
    sizes = tasks.groupBy("work_id").agg(F.count("*").alias("total"))
    low = F.regexp_extract(wanted, grammar, 1).try_cast("long")
    rows = selection.select("work_id", "wanted", (wanted == "").alias("all"), low.alias("low"), F.coalesce(F.regexp_extract(wanted, grammar, 2).try_cast("long"), low).alias("high")).join(sizes, "work_id", "left")
    valid = (F.col("low") >= 1) & (F.col("low") <= F.col("high")) & (F.col("high") <= F.coalesce("total", F.lit(0)))
    return rows.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("total")


def _fetched(tasks: DataFrame, details: DataFrame, illustrations: DataFrame | None, done: DataFrame | None, force: bool) -> dict[str, DataFrame]:
    """What becomes of tasks (work_id, number, id): those without a file are met with landed details (id, json) and written."""
    numbered = tasks.select("work_id", pad3(F.col("number")).alias("chapter_num"), F.col("id").alias("novel_id"))
    todo = numbered
    if done is not None and not force:
        have = done.select("work_id", pad3(F.col("prefix").try_cast("long")).alias("chapter_num")).where("chapter_num is not null").distinct()
        todo = numbered.join(have, ["work_id", "chapter_num"], "left_anti")
    landed_ = details.select(F.col("id").alias("novel_id"), "json")
    out = landed.download(todo.join(landed_, "novel_id", "left"), illustrations)
    size = lambda df, name: df.groupBy("work_id").agg(F.count("*").alias(name))
    totals = size(numbered, "n_tasks").join(size(todo, "n_todo"), "work_id", "left").join(size(out["records"], "n_done"), "work_id", "left").na.fill(0, ["n_todo", "n_done"])
    told = out["metadata"].groupBy("work_id").agg(F.sum("word_count").alias("n_words"))
    totals = totals.join(told, "work_id", "left").select("work_id", "n_tasks", (F.col("n_tasks") - F.col("n_todo")).alias("n_skipped"), "n_done", (F.col("n_todo") - F.col("n_done")).alias("n_failed"), F.coalesce("n_words", F.lit(0)).alias("n_words"))
    return out | {"todo": todo, "totals": totals, "summary": index.summary(out["metadata"], "work_id")}


def novel(novels: DataFrame, details: DataFrame, illustrations: DataFrame | None = None, done: DataFrame | None = None, force: bool = False) -> dict[str, DataFrame]:
    """Single works: novels (work_id, id), each one chapter; see ``series`` for the tables given back and for done and force."""
    return _fetched(novels.select("work_id", F.lit(1).alias("number"), "id"), details, illustrations, done, force)


def csv(tasks: DataFrame, details: DataFrame, illustrations: DataFrame | None = None, done: DataFrame | None = None, force: bool = False) -> dict[str, DataFrame]:
    """An import list: tasks (work_id, chapter_num, novel_id), of which those whose number is none do not count and of a number the greatest id does."""
    rows = tasks.select("work_id", F.col("chapter_num").try_cast("long").alias("number"), F.col("novel_id").alias("id")).where("number is not null")
    return _fetched(rows.groupBy("work_id", "number").agg(F.max("id").alias("id")), details, illustrations, done, force)


def series(overviews: DataFrame, pages: DataFrame, details: DataFrame, selection: DataFrame | None = None, start: int = 1, illustrations: DataFrame | None = None, done: DataFrame | None = None, force: bool = False) -> dict[str, DataFrame]:
    """Whole series from what has landed: overviews (work_id, json), listing pages (work_id, page_no, json) and chapters details (id, json).

    Chapters are numbered in the order of their pages from ``start``; with a selection (work_id, wanted) they keep the numbers of their
    places. done (work_id, prefix) are chapters that have files: they are skipped, unless forced. Given back are the tables of
    ``landed.download``, and info (work_id, text), the page of each series; tasks (work_id, pos, id, words); todo, those fetched; totals (work_id, n_tasks,
    n_skipped, n_done, n_failed, n_words); summary (work_id, summary).
    """
    listed = files.listing_rows(pages)
    order = running(listed.select("work_id", "page_no", "pos", "id", "words"), ["work_id"], [F.col("page_no"), F.col("pos")], {"place": ("sum", F.lit(1).cast("long"))})
    tasks = order.select("work_id", F.col("place").alias("pos"), "id", "words")
    kept = selected(tasks, selection)
    numbered = kept.withColumn("number", F.col("pos") if selection is not None else F.col("pos") + (start - 1))
    out = _fetched(numbered, details, illustrations, done, force)
    about = landed.series_overview(overviews, "work_id")
    counts = tasks.groupBy("work_id").agg(F.sum("words").alias("words"), F.count("*").alias("chapters"))
    page = publish.series_info_page(F.col("work_id").cast("string"), F.col("title"), F.col("author"), F.col("update_time"), F.col("words"), F.col("chapters"), F.col("tags"), F.col("description"))
    info = about.join(counts, "work_id", "left").select("work_id", page.alias("text"))
    return out | {"tasks": tasks, "info": info}
