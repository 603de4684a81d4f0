"""Main text of web pages: flat text blocks classified by a decision tree.

Each block is described by its word count and link density, by those of its
neighbours, and by three weaker features of what encloses it (an article, signs of
page furniture, a heading). A tree is trained on the blocks of the small labelled
pages below when the operator is planned; it travels to the executors as a few
nested tuples.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches
from quire.llm.decision_tree import fit, predict
from quire.llm.html_blocks import blocks_of, features

# Pages labelled by hand, block by block: 1 for the article's blocks and 0 for any other, the block's words and
# how many of them are linked, and the elements around it ("div.a+b" has the class "a b"). A rule opens the next page.
LABELLED_PAGES = """
0 3 3 nav/li
0 1 1 nav/li
0 2 2 nav/li
0 9 0 div.ad
1 11 0 article/h1
1 70 0 article/p
1 55 2 article/p
1 3 0 article/p
1 60 0 article/p
0 7 0 footer
---
0 2 2 div.menu/li
0 2 2 div.menu/li
0 40 0 div.cookie-notice
1 6 0 main/h1
0 5 3 main/div.article-meta
1 90 0 main/p
0 8 8 main/p
1 80 3 main/p
0 4 4 main/p
1 45 0 main/p
0 35 0 main/section.comments/p
0 60 1 main/section.comments/p
0 12 2 footer
---
0 12 0 header/p
0 4 0 header/h1
1 8 0 article/header/h1
0 6 1 article/header/p
0 4 4 article/header/p
1 28 0 article/header/p
1 75 0 article/p
1 12 0 article/h2
1 1 0 article/p
1 40 4 article/p
0 25 0 article/aside/p
0 2 0 article/form
0 18 0 article/form/p
1 33 0 article/p
0 90 0 div/p
0 30 0 div/p
---
1 5 0 article/div.article-header/h1
0 5 0 article/div.article-header/p
1 22 0 article/div.article-header/p
1 60 0 article/section.social-history/p
1 20 0 article/section.social-history/p
1 34 0 article/section.search/p
0 2 2 article/section.social-links/li
0 2 2 article/section.social-links/li
0 5 4 article/div.search
0 4 0 article/div.form
1 50 0 article/div.rail/p
1 9 0 article/section.search/h2
---
1 1 0 article/header/h1
0 2 0 article/header/p
0 3 0 article/header/p
1 40 0 article/p
1 2 0 article/div.article-header/h2
0 2 0 article/div.article-header/p
1 30 0 article/p
1 4 0 article/header/h2
1 30 0 article/p
---
0 1 1 div/li
0 2 2 div/li
0 1 1 div/li
1 9 0 div/h1
1 64 0 div/p
1 30 1 div/p
1 6 0 div/p
1 85 2 div/p
0 6 6 div/p
1 42 0 div/p
0 12 12 div/li
0 9 9 div/li
0 14 13 div/li
0 5 0 div/p
---
0 3 1 div/p
0 4 0 div/p
0 2 2 div/p
1 7 0 div/h2
1 18 0 div/p
1 24 0 div/p
1 15 0 div/p
0 4 2 div/p
0 2 1 div/p
---
0 60 0 div.sidebar/p
0 22 0 div.newsletter/p
0 4 0 div.sidebar/h3
1 10 0 div/h1
1 44 0 div/p
1 38 0 div.social-history/p
0 3 0 div.social-box/p
0 30 0 div.disclaimer+footer/p
0 35 0 div.footer/p
0 5 5 div.footer/p
---
1 1 0 p
---
1 14 0 p
---
1 200 0 div
---
1 45 0 p
1 40 0 p
1 30 12 p
1 50 0 p
1 14 4 p
1 10 3 p
1 22 10 p
---
1 9 0 article/h1
1 20 4 article/p
1 12 3 article/p
1 8 3 article/p
1 6 2 article/p
1 5 1 article/p
1 15 7 article/p
1 22 12 article/p
0 10 7 article/p
0 6 4 article/p
0 12 9 article/p
1 40 30 article/p
1 60 20 article/p
---
0 4 4 nav/li
1 14 0 article/p
1 11 0 article/p
1 2 0 article/li
1 3 0 article/li
1 1 0 article/li
1 25 0 article/p
1 28 26 article/p
1 30 18 article/p
0 3 3 article/li
0 5 5 article/li
0 4 4 article/li
1 30 0 article/blockquote
1 6 6 article/h2
1 18 0 article/p
0 20 20 section/p
0 15 15 section/p
0 140 0 div/p
0 15 0 div/p
0 4 0 div/p
---
0 24 0 div/p
0 3 0 div/h3
1 5 0 article/h1
1 250 0 article/p
1 2 0 article/h3
1 120 10 article/p
0 14 0 article/div.advert/p
0 3 0 article/div.advert/h3
1 65 0 article/p
0 8 0 article/button
0 50 0 article/div.related/p
0 9 9 article/div.related/li
0 7 7 article/div.related/li
1 16 0 article/p
0 55 0 footer/p
0 3 0 footer/h4
"""


def _page(sketch: str) -> tuple[str, list[int]]:
    """The page that a sketch describes and the labels of its blocks."""
    page, labels = [], []
    for line in sketch.split("\n"):
        label, words, linked, path = line.split()
        elements = [e.partition(".") for e in path.split("/")]
        opened = "".join(f'<{tag} class="{name.replace("+", " ")}">' if name else f"<{tag}>" for tag, _, name in elements)
        text = f"<a href=x>{'w ' * int(linked)}</a>{'w ' * (int(words) - int(linked))}"
        page.append(opened + text + "".join(f"</{tag}>" for tag, _, _ in reversed(elements)))
        labels.append(int(label))
    return "".join(page), labels


def labelled_blocks() -> tuple[list[list[float]], list[int]]:
    """Feature rows and labels of all blocks of the labelled pages."""
    rows, labels = [], []
    for sketch in LABELLED_PAGES.strip().split("\n---\n"):
        page, known = _page(sketch)
        found = features(blocks_of(page))
        assert len(found) == len(known)
        rows += found
        labels += known
    return rows, labels


def train() -> tuple:
    return fit(*labelled_blocks())


def main_text(page: str | None, tree: tuple) -> str:
    blocks = blocks_of(page or "")
    return " ".join(b.text for b, f in zip(blocks, features(blocks)) if predict(tree, f))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html, ...).

    text is the article's blocks in page order joined by one space, empty if there are none; null and
    empty html give empty text, plain text without markup is one block. Repeated rows stay, null ids and
    urls stay null, other columns are ignored, an empty table gives no rows. A page is read whole, whatever its length.
    """
    tree = train()

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, tree) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), per_batch, "page_id long, url string, text string, n_chars long")
