import random
from html.parser import HTMLParser

from quire.llm import decision_tree, html_extract
from quire.llm.html_blocks import FURNITURE_WORDS, INLINE, blocks_of, features, furniture_of

PAGE = (
    '<!DOCTYPE html><html class="has-sidebar"><head><title>T</title><style>p{}</style><script>var t="</p>";if(a<b)x();</script></head><body><header><h1>Site</h1><nav><ul><li><a href="/a">A</a></li></ul></nav></header>'
    '<div id="cookie-notice">We use cookies on this site, please agree to all of them.</div><main><article><h1>T &amp; t</h1><p>One <b>tw</b>o&nbsp;three&#8230;<br>four<p>Next 5 < 6 &lt;b&gt; para\n  graph'
    '<aside>Related things to read</aside><form>Sign up <input name=x> here</form><div class="advert">Buy more of these fine things today</div><section class="comments"><p>nice post, I liked it very much</p></section>'
    "<p>end</p></article></main><footer>&copy; 2020 someone</footer></body></html>"
)


def test_article_text():
    assert html_extract.main_text(PAGE, html_extract.train()) == "T & t One two three… four Next 5 < 6 <b> para graph end"


def test_broken_pages():
    tree = html_extract.train()
    assert html_extract.main_text(None, tree) == "" == html_extract.main_text("", tree)
    assert html_extract.main_text("<article><p>kept &amp", tree) == "kept &"
    assert html_extract.main_text("<article><p>kept <a href='x", tree) == "kept"
    assert html_extract.main_text("<article><p>kept</p><!-- open", tree) == "kept"
    assert html_extract.main_text('<article><p title="a>b">x</p></article>', tree) == "x"
    assert html_extract.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000, tree) == "deep"
    long = "word " * 50_000
    assert html_extract.main_text(f"<article><p>{long}</p></article>", tree) == long.strip()


def test_many_unmatched_quotes_take_linear_time():
    assert blocks_of("<a '" * 20_000 + "x") is not None


def test_unclosed_tags_take_linear_time():
    n = 100_000
    assert len(blocks_of("<b>x" * n)) == 1
    assert len(blocks_of("<b>" * n + "<p>y</p>" * n)) == n
    assert len(blocks_of("<div>x" * n + "</i>" * n)) == n
    assert len(blocks_of('<p x="1" y=' + '="2" ' * n + ">z")) == 1


def test_tree_separates_its_pages():
    rows, labels = html_extract.labelled_blocks()
    tree = html_extract.train()
    assert sum(decision_tree.predict(tree, r) == y for r, y in zip(rows, labels)) >= 0.97 * len(rows)
    assert decision_tree.fit([[0.0], [0.0]], [1, 0]) == (1,)


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefg") for _ in range(4)) for _ in range(n))


def test_size_and_link_density_decide_under_equal_tags():
    tree = html_extract.train()
    text = lambda page: html_extract.main_text(page, tree)
    prose, more = words(60), words(45, 1)
    assert text(f"<div><div><a href=x>One</a></div><div><a href=x>Two</a></div><div>{prose}</div><div>{more}</div><div><a href=x>{words(5)}</a></div></div>") == f"{prose} {more}"
    assert text(f"<article><p>{prose}</p><p><a href=x>Read our other story</a></p><p>{more}</p></article>") == f"{prose} {more}"
    mixed = f"See <a href=x>this one</a> for {words(9)}"
    assert text(f"<article><p>{prose}</p><p>{mixed}</p></article>") == f"{prose} See this one for {words(9)}"
    assert text(f"<article><p>{words(3)}</p><section class='social-history'><p>{prose}</p><p>{words(2)}</p></section><p>{more}</p></article>") == f"{words(3)} {prose} {more}"


def test_class_words_only_hint():
    tree = html_extract.train()
    prose = words(40)
    assert html_extract.main_text(f'<article><div class="article-header"><h1>Title</h1></div><p>{prose}</p></article>', tree) == f"Title {prose}"
    assert html_extract.main_text(f"<article><header><h1>T</h1><p>By Bob</p></header><p>{prose}</p></article>", tree) == f"T {prose}"
    for name in ("social-history", "search", "post form", "rail", "media alert", "search-theory"):
        assert html_extract.main_text(f'<article><p>{words(20)}</p><section class="{name}"><p>{prose}</p></section></article>', tree).endswith(prose)
    for name in ("comments", "comment-list", "reader-comments", "site-footer", "cookie-notice", "left_sidebar", "newsletter-signup", "ad", "post-comments", "relatedPosts", "footer dark-theme"):
        assert html_extract.main_text(f'<article><p>{words(20)}</p><section class="{name}"><p>{prose}</p></section></article>', tree) == words(20), name
    assert furniture_of("content") == (0, True) and furniture_of("") == (0, False) and furniture_of("content has-sidebar") == (0, True)
    assert all(furniture_of(w)[0] == 2 for w in FURNITURE_WORDS)


class Plain(HTMLParser):
    """Blocks of well-formed pages by the standard parser: (text, linked words)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.text, self.linked, self.depth = [], "", "", 0

    def flush(self):
        t = " ".join(self.text.split())
        if t:
            self.found.append((t, len(self.linked.split())))
        self.text = self.linked = ""

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        self.depth += tag == "a"

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        self.depth -= tag == "a"

    def handle_data(self, data):
        self.text += data
        self.linked += data if self.depth else " "


def test_blocks_and_features_match_the_standard_parser():
    r = random.Random(5)

    def element(depth):
        tag = r.choice(["div", "section", "p", "ul", "b", "i", "a", "span"] if depth < 4 else ["b", "a"])
        body = "".join(element(depth + 1) if depth < 6 and r.random() < 0.5 else f" {words(r.randint(0, 6), r.random())} &amp; " for _ in range(r.randint(1, 4)))
        return f"<{tag}>{body}</{tag}>" if tag != "a" or "<a>" not in body else f"<div>{body}</div>"

    for _ in range(60):
        page = "".join(element(0) for _ in range(4)).replace("<p>", "<div>").replace("</p>", "</div>")
        plain = Plain()
        plain.feed(page)
        plain.close()
        plain.flush()
        blocks = blocks_of(page)
        assert [b.text for b in blocks] == [t for t, _ in plain.found]
        rows = features(blocks)
        sizes = [(len(t.split()), n) for t, n in plain.found]
        for k, row in enumerate(rows):
            around = [sizes[j] if 0 <= j < len(sizes) else (0, 0) for j in (k, k - 1, k + 1)]
            assert row[0] == around[0][0] and row[2] == around[1][0] and row[4] == around[2][0]
            for at, (n, linked) in zip((1, 3, 5), around):
                assert abs(row[at] - (min(n, linked) / n if n else 0)) < 1e-9
        assert all(row[6] == 1.0 for row in rows)


def test_operator(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "x")], "page_id long, url string, html string, text string")
    got = sorted([(r.page_id, r.n_chars, len(r.text)) for r in html_extract.extract(df).collect()], key=str)
    n = len(html_extract.main_text(PAGE, html_extract.train()))
    assert got == sorted([(1, n, n), (1, n, n), (None, 0, 0), (2, 0, 0)], key=str)
    assert html_extract.extract(df.where("false")).count() == 0


def test_hidden_elements_are_no_text():
    from quire.llm.html_blocks import blocks_of, is_hidden

    page = """<article><p>Seen <span hidden>not this</span>and <b style="font-weight: bold">this</b>.</p><div style='DISPLAY : none'><p>not <i>this</i></p></div>
    <p style="visibility:hidden">nor this</p><p class="hidden" data-hidden="x" title="hidden">but this</p><div hidden="">no<p>no</div><p>end</article>"""
    assert [b.text for b in blocks_of(page)] == ["Seen and this.", "but this", "end"]
    assert not is_hidden(' class="hidden" style="overflow:hidden"') and not is_hidden(" data-hidden=1 aria-hidden=true") and is_hidden(" id=a hidden") and is_hidden(" style=display:none")
