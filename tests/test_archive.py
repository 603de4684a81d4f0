import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import archive, chunks, publish, reports, overlay, diff
from quire.sources import sink


def entries(spark, rows):
    return spark.createDataFrame(rows, "work_id string, section int, k long, name string, data binary, stored boolean")


def by_zipfile(rows):
    """The same archive by the standard writer."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for _, _, _, name, data, stored in sorted(rows, key=lambda x: (x[1], x[2], x[3])):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data or b"", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    made = [("w", r.randrange(3), k, f"d/页{k}.x" if k % 3 else f"p{k}", r.choice([None, b"", b"text " * r.randint(0, 900), r.randbytes(300)]), k % 5 == 0) for k in range(60)]
    return made + [("v", 0, 0, "mimetype", b"t", True)]


@pytest.mark.parametrize("most, few", [(archive.MOST_BYTES, archive.MOST_ENTRIES), (500, 10)])
def test_parts_are_the_bytes_of_the_standard_writer(spark, rows, monkeypatch, most, few):
    monkeypatch.setattr(archive, "MOST_BYTES", most)
    monkeypatch.setattr(archive, "MOST_ENTRIES", few)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", most)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", few)
    got = archive.parts(entries(spark, rows)).orderBy("part_no").collect()
    for work in ("w", "v"):
        own, at = [p for p in got if p.work_id == work], 0
        assert [p.part_no for p in own] == list(range(1, len(own) + 1))
        for p in own:
            assert p.offset == at
            at += len(p.content)
        made = b"".join(bytes(p.content) for p in own)
        with zipfile.ZipFile(io.BytesIO(made)) as z:
            assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {r[3]: r[4] or b"" for r in rows if r[0] == work}
        if most > 1000:
            assert made == by_zipfile([r for r in rows if r[0] == work])


def test_no_part_is_larger_than_an_entry_and_files_come_from_parts(spark, tmp_path):
    pages = spark.createDataFrame([(w, f"c{k:03d}.xhtml", "chap", f"t{k}", None, k, "x" * 50_000) for w in ("a", "b") for k in range(1, 40)], "work_id string, page_name string, kind string, title string, vol_no int, play_order int, page_html string")
    info = spark.createDataFrame([("a", "Same", "A"), ("b", "Other", None)], "work_id string, title string, author string")
    parts = publish.book_parts(pages, info, "p {}", "2020-01-01T00:00:00Z").cache()
    assert parts.agg(F.max(F.length("content"))).first()[0] < 20_000
    sink.write_parts(parts, str(tmp_path / "out"))
    whole = {r.file_name: bytes(r.content) for r in publish.books(pages, info, "p {}", "2020-01-01T00:00:00Z").collect()}
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == whole and set(whole) == {"Same.epub", "Other.epub"}
    same = parts.withColumn("file_name", F.lit("one.epub"))
    sink.write_parts(same, str(tmp_path / "one"))
    assert (tmp_path / "one/one.epub").read_bytes() in whole.values()


def test_chunks_joined_are_the_text(spark):
    r = random.Random(3)
    rows = [(r.choice(["w", "w", "w", "x", None]), r.choice([None, 1, 2]), k, r.choice([None, "", "é" * r.randint(1, 40), "中文\n"])) for k in range(300)]
    got = chunks.chunked(spark.createDataFrame(rows, "work_id string, a int, b int, text string"), ["a", "b"], size=50).collect()
    for work in ("w", "x", None):
        own = sorted((g for g in got if g.work_id == work), key=lambda g: g.chunk_no)
        want = "".join(x[3] or "" for x in sorted((x for x in rows if x[0] == work), key=lambda x: (x[1] is not None, x[1] or 0, x[2])))
        assert "".join(g.text for g in own) == want and [g.chunk_no for g in own] == list(range(1, len(own) + 1))
        at = 0
        for g in own:
            assert g.offset == at and len(g.text) < 50 + 40
            at += len(g.text)


def test_chunks_of_reports_and_lineage(spark):
    r = random.Random(5)
    layer = lambda n, s: spark.createDataFrame([("w", f"{k:03d}" if k % 7 else f"x{k}", f"{k:03d} {s if k % 3 else 'a'}.txt", "\n".join(r.choice("abc") for _ in range(5))) for k in range(n)], "work_id string, chapter_key string, file_name string, text string").cache()
    a, b = layer(40, "a"), layer(50, "b")
    found = diff.compare(a, b)
    assert [tuple(x) for x in chunks.whole(reports.report_chunks(found, size=200)).collect()] == [tuple(x) for x in reports.directory_report(found).collect()]
    done = overlay.assemble(a, b)
    assert [tuple(x) for x in chunks.whole(overlay.lineage_chunks(done, 30)).collect()] == [tuple(x) for x in overlay.lineage_lines(done).collect()]


def test_names_of_many_books_are_dealt_to_several_tasks(spark):
    pages = spark.range(400).select(F.expr("id div 10").alias("work_id"), F.concat(F.lit("c"), "id").alias("page_name"), F.lit("chap").alias("kind"), F.concat(F.lit("t"), "id").alias("title"), F.lit(None).cast("int").alias("vol_no"), (F.col("id") % 10).alias("play_order"), F.lit("x").alias("page_html"))
    info = pages.select("work_id", F.lit("T").alias("title"), F.lit("A").alias("author")).distinct()
    packages = publish.book_entries(pages, info, "p {}", "2020-01-01T00:00:00Z").where("section = 7").select("work_id", F.spark_partition_id().alias("task")).collect()
    assert len(packages) == 3 * 40 and len({r.task for r in packages}) > 1
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_pages_of_books_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def titled(n):
        made.add(1)
        return f"t{n}"

    rows = spark.range(0, 60, 1, 2).select(F.expr("id div 20").alias("work_id"), F.concat(F.lit("c"), "id").alias("page_name"), F.lit("chap").alias("kind"), F.udf(titled, "string")("id").alias("title"), F.lit(None).cast("int").alias("vol_no"), (F.col("id") % 20).alias("play_order"))
    pages = rows.withColumn("page_html", F.concat(F.lit("<h1>"), "title", F.lit("</h1>")))
    info = spark.range(3).select(F.col("id").alias("work_id"), F.lit("T").alias("title"), F.lit("A").alias("author"))
    books = publish.books(pages, info, "p {}", "2020-01-01T00:00:00Z").collect()
    assert made.value == 60
    for b in books:
        with zipfile.ZipFile(io.BytesIO(bytes(b.content))) as z:
            assert z.testzip() is None and all(z.read(f"OEBPS/c{n}") == f"<h1>t{n}</h1>".encode() for n in range(20 * b.work_id, 20 * b.work_id + 20))
            assert z.read("OEBPS/toc.ncx").count(b"<navPoint ") == 20
