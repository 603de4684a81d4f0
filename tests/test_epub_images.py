"""Books keep their illustrations, covers and split titles."""

import io
import zipfile

from quire import api
from quire.operators import overlay, volumes

STYLES = '{"chapter": {"two": {"split": true, "num_color": "#123456", "num_size": "2em"}}, "volume": {"v": {"vol_num_color": "#654321"}}}'


def read(row):
    with zipfile.ZipFile(io.BytesIO(bytes(row.content))) as z:
        return {n: z.read(n) for n in z.namelist()}


def test_book_with_images_cover_and_split_titles(spark):
    rows = [("w", "001 第一章 a.txt", "第一章 a\nx<【插图: p&q.png】y【插图：gone.png】 z\n【插图: b.jpg】"), ("w", "002 番外：s.txt", "t"), ("x", "001 c.txt", "【插图: b.jpg】")]
    base = overlay.with_keys(spark.createDataFrame(rows, "work_id string, file_name string, text string"))
    ranges = volumes.valid_volumes(spark.createDataFrame([("w", 0, "第一卷 V", 1, 1)], "work_id string, pos int, name string, start long, end long"))
    info = spark.createDataFrame([("w", "T", "A"), ("x", "U", "A")], "work_id string, title string, author string")
    images = spark.createDataFrame([("w", "p&q.png", 1, b"P1"), ("w", "p&q.png", 0, b"P0"), ("w", "b.jpg", 0, b"B"), ("w", "n.gif", 0, b"N"), ("w", "unused.png", 0, b"U"), ("w", "../e.png", 0, b"E")], "work_id string, img string, priority int, content binary")
    notes = spark.createDataFrame([("w", "002", 1, "n.gif", ["d1", "d<2"]), ("w", "002", 2, "none.png", ["d"])], "work_id string, chapter string, pos int, img string, desc array<string>")
    covers = spark.createDataFrame([("w", "c.PNG", b"C"), ("none", "c.png", b"C")], "work_id string, img string, content binary")
    made = api.epub(base, ranges=ranges, info=info, styles=STYLES, title_style="two", vol_style="v", modified="2020-01-01T00:00:00Z", images=images, illustrations=notes, covers=covers)
    books = {r.work_id: read(r) for r in made.collect()}
    assert set(books) == {"w", "x"}
    w = books["w"]
    assert {n: b for n, b in w.items() if n.startswith("OEBPS/img/") or n == "OEBPS/cover.png"} == {"OEBPS/img/p&q.png": b"P0", "OEBPS/img/b.jpg": b"B", "OEBPS/img/n.gif": b"N", "OEBPS/cover.png": b"C"}
    page = next(b.decode() for b in w.values() if b"x&lt;" in b)
    shown = '<div class="illustration"><img src="img/{}" alt="插图"/></div>'
    assert f"<p>x&lt;</p>\n{shown.format('p&amp;q.png')}\n<p>y【插图：gone.png】 z</p>\n{shown.format('b.jpg')}\n</body>" in page
    assert '<h1><div class="chapter-num">第一章</div><div class="chapter-name">a</div></h1>' in page
    side = next(b.decode() for b in w.values() if b"<p>t</p>" in b)
    assert '<img src="img/n.gif" alt="插图"/><div class="illustration-desc">d1<br/>d&lt;2</div>' in side and "none.png" not in side
    volume = next(b.decode() for n, b in w.items() if "/vol_" in n)
    assert '<body class="vol">\n<h1><div class="volume-num">第一卷</div><div class="volume-name">V</div></h1>' in volume
    css, opf = w["OEBPS/style.css"].decode(), w["OEBPS/content.opf"].decode()
    assert "#123456" in css and "font-size: 2em" in css and "#654321" in css
    for part in ('href="img/p&amp;q.png" media-type="image/png"', 'href="img/n.gif" media-type="image/gif"', 'href="cover.png" media-type="image/png" properties="cover-image"', '<meta name="cover" content="cover-img"/>', "<guide>"):
        assert part in opf
    assert 'src="cover.png"' in w["OEBPS/cover.xhtml"].decode() and 'href="cover.xhtml"' in w["OEBPS/nav.xhtml"].decode()
    assert not [n for n in books["x"] if "img" in n or "cover" in n] and any("【插图: b.jpg】".encode() in b for b in books["x"].values())


def test_the_information_page_stands_in_front(spark):
    page = "书籍信息\n\nT & t\n\n作者：未填\n\n连载状态：9章（2020年1月2日）\n\n字数：0.0万字\n\n简介：\n\none\n\ntwo\n"
    rows = [("w", "000 书籍信息.txt", page), ("w", "001 a.txt", "x"), ("w", "002 番外 b.txt", "y"), ("v", "001 a.txt", "x")]
    base = overlay.with_keys(spark.createDataFrame(rows, "work_id string, file_name string, text string"))
    ranges = volumes.valid_volumes(spark.createDataFrame([("w", 0, "V", 1, 1)], "work_id string, pos int, name string, start long, end long"))
    info = spark.createDataFrame([("w", None, "A"), ("v", "V", "B")], "work_id string, title string, author string")
    books = {r.work_id: (r.file_name, read(r)) for r in api.epub(base, ranges=ranges, info=info, modified="2020-01-01T00:00:00Z").collect()}
    assert books["w"][0] == "T & t.epub" and books["v"][0] == "V.epub" and "OEBPS/book_info.xhtml" not in books["v"][1]
    shown = books["w"][1]["OEBPS/book_info.xhtml"].decode()
    assert '<p class="book-info-name">T &amp; t</p>\n<p>作者：A</p>\n<p>连载状态：1章+1番外（2020年1月2日）</p>\n<p>卷/篇数：1</p>\n<p>字数：0.0万字</p>\n<p>简介：</p>\n<p>one</p>\n<p>two</p>\n</body>' in shown
    opf = books["w"][1]["OEBPS/content.opf"].decode()
    assert opf.index('href="book_info.xhtml"') < opf.index('href="vol_') and books["w"][1]["OEBPS/nav.xhtml"].decode().count("<li>") == 4
    plain = {r.work_id: r.file_name for r in api.epub(base, ranges=ranges, modified="2020-01-01T00:00:00Z").collect()}
    assert plain == {"w": "T & t.epub", "v": "未填.epub"}
