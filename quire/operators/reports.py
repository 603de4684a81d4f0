"""Reports of comparisons as text: of two files, and of two layers in sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import first_difference, once, paragraphs
from quire.operators.chunks import SIZE, chunked

_NONE = "array<string>"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _paired(base: Column, other: Column) -> Column:
    """array<struct<line_no, text1, text2>>: paragraphs side by side, null where a side has none."""
    return F.transform(F.arrays_zip(base.alias("a"), other.alias("b")), lambda p, k: F.struct((k + 1).alias("line_no"), p["a"].alias("text1"), p["b"].alias("text2")))


def _changed(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: p["text1"].isNotNull() & p["text2"].isNotNull() & (p["text1"] != p["text2"]))


def _surplus(pairs: Column, mine: str, other: str) -> Column:
    return F.filter(pairs, lambda p: p[mine].isNotNull() & p[other].isNull())


def comparison_text(files: DataFrame, compat: bool = False) -> DataFrame:
    """files with report: what a comparison of text1 and text2 says, paragraph by paragraph.

    Surplus paragraphs have their own ordinals; with compat the shorter side is counted twice. Null texts have no paragraphs.
    """
    none = F.array().cast(_NONE)
    names = files.columns
    rows = once(files, _pairs=_paired(F.coalesce(paragraphs(F.col("text1")), none), F.coalesce(paragraphs(F.col("text2")), none)))
    rows = once(rows, _c=F.transform(_changed(F.col("_pairs")), lambda p: F.struct(p["line_no"].alias("n"), p["text1"].alias("t1"), p["text2"].alias("t2"), first_difference(p["text1"], p["text2"]).alias("d"))), _l=_surplus(F.col("_pairs"), "text1", "text2"), _r=_surplus(F.col("_pairs"), "text2", "text1"))
    # The sentences of the report.
    each = F.transform(
        F.col("_c"),
        lambda c, k: _text("第 ", k + 1, " 个错误：\n文件1第 ", c["n"], " 行：\n", c["t1"], "\n文件2第 ", c["n"], " 行：\n", c["t2"], "\n第一个不同的字符在位置 ", c["d"]["pos"], "，'", c["d"]["char1"], "' vs '", c["d"]["char2"], "'，这段共有 1 个错误\n\n"),
    )
    shift = F.size("_pairs") - F.greatest(F.size("_l"), F.size("_r")) if compat else F.lit(0)
    extra = lambda side, rows, text: F.transform(F.col(rows), lambda p: _text(f"文件{side}额外的行 ", p["line_no"] + shift, "：'", p[text], "'\n"))
    total = F.size("_c") + F.size("_l") + F.size("_r")
    report = F.concat(F.lit("文件1和文件2之间的差异：\n\n"), F.array_join(each, ""), _text("总共 ", total, " 处错误"), F.array_join(extra(1, "_l", "text1"), ""), F.array_join(extra(2, "_r", "text2"), ""))
    return rows.select(*names, report.alias("report"))


def _chapter_section(preview: int) -> Column:
    """The report of one modified chapter of compared rows."""
    pairs = _paired(F.col("paras_base"), F.col("paras_corrected"))
    changed, gone, added = _changed(pairs), _surplus(pairs, "text1", "text2"), _surplus(pairs, "text2", "text1")
    prefixed = F.col("chapter_key").rlike("^[0-9]+$")
    renamed = F.when(F.col("base_name") != F.col("corrected_name"), F.concat(F.lit("  vs  "), "corrected_name")).otherwise(F.lit(""))
    title = F.when(prefixed, F.concat(F.lit("["), "chapter_key", F.lit("] "), "base_name", renamed)).otherwise(F.col("base_name"))
    first = lambda rows: F.slice(rows, 1, preview)

    def change(c: Column) -> Column:
        d = F.array(first_difference(c["text1"], c["text2"]))
        return F.transform(d, lambda d: _text("\n  第 ", c["line_no"], " 段 第 ", d["pos"], " 字: '", d["char1"], "' vs '", d["char2"], "'\n    标准化: ", c["text1"], "\n    校正版: ", c["text2"]))[0]

    def surplus(rows: Column, head: str, side: str, text: str, rest: str) -> Column:
        shown = F.transform(first(rows), lambda p: _text("\n    第 ", p["line_no"], f" 段 ({side}独有): ", p[text]))
        more = F.when(F.size(rows) > preview, _text("\n    ... 剩余 ", F.size(rows) - preview, f" 段{rest}见日志文件")).otherwise(F.lit(""))
        return F.when(F.size(rows) > 0, F.concat(_text(f"\n  校正版{head}了 ", F.size(rows), " 段:"), F.array_join(shown, ""), more)).otherwise(F.lit(""))

    more = F.when(F.size(changed) > preview, _text("\n    ... 剩余 ", F.size(changed) - preview, " 处段落差异见日志文件")).otherwise(F.lit(""))
    rest = F.when(prefixed, F.concat(more, surplus(gone, "删除", "标准化", "text1", "删除"), surplus(added, "新增", "校正", "text2", "新增"))).otherwise(F.lit(""))
    return F.concat(F.lit("\n===== "), title, _text(" — ", F.col("n_diffs"), " 处差异 ====="), F.array_join(F.transform(first(changed), change), ""), rest)


#: Sections in order, with the line above each.
MODIFIED, RENAMED, MODIFIED_NAMED, EQUAL, ONLY_BASE, ONLY_CORRECTED, TOTALS = range(7)


def report_parts(compared: DataFrame, preview: int = 3) -> DataFrame:
    """(work_id, section, a, b, c, text): the parts of a comparison's report (rows of diff.compare), in the order of section, a, b and c.

    Chapters with differences (``preview`` of each kind in full), chapters that only changed their name, those without a number,
    those in one layer only, then the totals. Within a section numbers come in numeric order, names by code point.
    """
    prefixed = F.col("chapter_key").rlike("^[0-9]+$")
    status = F.col("status")
    section = (
        F.when((status == "modified") & prefixed, MODIFIED).when(status == "renamed_only", RENAMED).when(status == "modified", MODIFIED_NAMED).when(status == "only_baseline", ONLY_BASE).when(status == "only_corrected", ONLY_CORRECTED)
    )
    named = F.coalesce("base_name", "corrected_name")
    numbered = F.concat(F.when(prefixed, F.concat(F.lit("["), "chapter_key", F.lit("] "))).otherwise(F.lit("")), named)
    line = F.when(status == "modified", _chapter_section(preview)).when(status == "renamed_only", F.concat(F.lit("  "), numbered, F.lit("  ->  "), "corrected_name")).otherwise(F.concat(F.lit("  "), numbered))
    shown = compared.withColumn("section", section)
    # lines of a section follow its head, which stands at a = 0
    lines = shown.where("section is not null").select("work_id", "section", F.when(prefixed, F.lit(1)).otherwise(F.lit(2)).alias("a"), F.when(prefixed, F.col("chapter_key").cast("decimal(38,0)")).alias("b"), F.col("chapter_key").alias("c"), F.concat(line, F.lit("\n")).alias("text"))
    counts = shown.groupBy("work_id").agg(*[F.count_if(F.col("section") == s).alias(f"n{s}") for s in (MODIFIED, RENAMED, MODIFIED_NAMED, ONLY_BASE, ONLY_CORRECTED)], F.count_if(status == "unchanged").alias("same"))
    # The sentences of the report.
    heads = {MODIFIED: ("", " 个配对文件发现内容差异："), RENAMED: ("", " 个文件仅改了文件名（内容一致）:"), MODIFIED_NAMED: ("", " 个无前缀文件发现差异:"), ONLY_BASE: ("仅标准化目录存在 ", " 个文件（未校正）:"), ONLY_CORRECTED: ("仅校正目录存在 ", " 个文件（新增）:")}
    n = lambda *s: sum((F.col(f"n{k}") for k in s[1:]), F.col(f"n{s[0]}"))
    told = [F.struct(F.lit(s).alias("section"), F.when(n(s) > 0, _text("\n" + before, n(s), behind + "\n")).alias("text")) for s, (before, behind) in heads.items()]
    equal = F.when(n(MODIFIED, RENAMED, MODIFIED_NAMED) == 0, F.lit("\n所有配对文件内容完全一致，无差异。\n"))
    last = _text("\n对比完成: ", n(MODIFIED, MODIFIED_NAMED), " 篇改动，", F.col("same") + n(RENAMED), " 篇未改（其中 ", n(RENAMED), " 篇仅改名），", n(ONLY_BASE), " 篇未校正，", n(ONLY_CORRECTED), " 篇新增\n")
    told += [F.struct(F.lit(EQUAL).alias("section"), equal.alias("text")), F.struct(F.lit(TOTALS).alias("section"), last.alias("text"))]
    frame = counts.select("work_id", F.explode(F.array(*told)).alias("t")).where("t.text is not null")
    return lines.unionByName(frame.select("work_id", "t.section", F.lit(0).alias("a"), F.lit(None).cast("decimal(38,0)").alias("b"), F.lit(None).cast("string").alias("c"), "t.text"))


def directory_report(compared: DataFrame, preview: int = 3) -> DataFrame:
    """(work_id, report): the report of each work in one cell; ``report_chunks`` has no such bound."""
    order = F.struct("section", "a", "b", "c", "text")
    rows = F.transform(F.array_sort(F.collect_list(order)), lambda x: x["text"])
    return report_parts(compared, preview).groupBy("work_id").agg(F.array_join(rows, "").alias("report"))


def report_chunks(compared: DataFrame, preview: int = 3, size: int = SIZE) -> DataFrame:
    """(work_id, chunk_no, offset, text): the same report as numbered chunks."""
    return chunked(report_parts(compared, preview), ["section", "a", "b", "c"], size=size)
