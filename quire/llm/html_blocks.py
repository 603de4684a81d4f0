"""A page as flat text blocks, with the features that tell an article's blocks from the rest."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Fixed values of HTML: elements without content, elements whose content is not text of the page,
# and elements that do not begin a block of their own.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe svg math object canvas audio video select noframes xmp".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
FURNITURE_TAGS = set("nav footer aside form button menu dialog fieldset".split())
CONTENT_TAGS = {"article", "main"}
# Words of class, id and role values: page furniture; words that only say where something stands or how it
# looks; the article. A value of furniture words alone, but for such neutral ones, names furniture, a mixture
# ("article-header", "social-history") only hints at it.
FURNITURE_WORDS = set(
    "nav navbar navigation menu header masthead footer contentinfo sidebar aside complementary ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner "
    "cookie cookies consent notice notices alert alerts gdpr popup modal overlay comment comments commentlist reply replies respond disqus discussion login signup subscribe newsletter "
    "share sharing related recommended breadcrumb breadcrumbs pagination pager widget toolbar skip".split()
)
HINT_WORDS = set("search form forms rail social links teaser".split())
NEUTRAL_WORDS = set(
    "site page main left right top bottom center box block list item items wrap wrapper container section area slot unit inner outer bar global primary secondary user reader readers visitor "
    "buttons button icons posts stories row grid flex text title body sticky fixed dark light small large hidden role type id js".split()
)
ARTICLE_WORDS = set("article content main post entry story maincontent".split())
_RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VALUE = re.compile(r""""[^"]*"|'[^']*'""")
_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])", re.I)
_STYLE = re.compile(r"""(?<![\w-])style\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_STOP = re.compile(r"""=\s*(["'])|>""")
_ENDED_BY = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

#: Word count and link density of a block and of its neighbours; then what encloses it. place: 0 outside the
#: article of a page that has one, 1 on a page without, 2 inside. furniture: 0 nothing says so, 1 a hint, 2 named.
FEATURES = ["words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "place", "furniture", "heading"]


@dataclass
class Block:
    text: str
    words: int
    linked: int
    in_content: bool
    furniture: int
    heading: bool

    @property
    def link_density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def furniture_of(value: str) -> tuple[int, bool]:
    """(grade of furniture, names the article) of a class, id or role value."""
    parts = [{t.lower() for t in _TOKENS.findall(part)} for part in value.split()]
    parts = [tokens for tokens in parts if not tokens & {"with", "has", "no"}]
    article = any(tokens & ARTICLE_WORDS for tokens in parts)
    grade = 0
    for tokens in parts:
        named, hint = tokens & FURNITURE_WORDS, tokens & HINT_WORDS
        rest = {t for t in tokens - named - hint - NEUTRAL_WORDS if len(t) > 2 and not t.isdigit()}
        if named != {"header"}:  # comments of an article are comments, but its header holds its title
            rest -= ARTICLE_WORDS
        elif tokens & {"page", "section", "title"}:
            rest.add("title")
        if named and not rest:
            grade = max(grade, 1 if len(parts) > 1 and (article or any(p & {"media", "press"} for p in parts)) and tokens.isdisjoint(ARTICLE_WORDS) else 2)
        elif named or hint:
            grade = max(grade, 1)
    return grade, article and not grade


def is_hidden(attrs: str) -> bool:
    """Whether an element's attributes keep it from being shown: hidden, or a style of its own."""
    low = attrs.lower()
    if "hidden" in low and _HIDDEN.search(_VALUE.sub('""', attrs)):
        return True
    return ("none" in low or "hidden" in low) and any(_UNSEEN.search(m[1] or m[2] or m[3] or "") for m in _STYLE.finditer(attrs))


class _Page:
    """Open elements as a stack with counters, so that no text walks it."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, int, bool]] = []
        self.block_at: list[int] = []  # places of the elements that are not inline
        self.open: dict[str, int] = {}
        self.content = self.hinted = self.named = self.hidden = 0
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.blocks: list[Block] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            words = text.count(" ") + 1
            linked = min(words, len("".join(self.linked).split()))
            heading = any(self.open.get(h) for h in HEADINGS)
            self.blocks.append(Block(text, words, linked, self.content > 0, 2 if self.named else 1 if self.hinted else 0, heading))
        self.parts.clear()
        self.linked.clear()

    def add(self, raw: str) -> None:
        if raw and not self.hidden:
            text = html.unescape(raw)
            self.parts.append(text)
            self.linked.append(text if self.open.get("a") else " ")

    def push(self, name: str, content: bool, furniture: int, hidden: bool = False) -> None:
        if name not in INLINE:
            self.block_at.append(len(self.stack))
        self.stack.append((name, content, furniture, hidden))
        self.open[name] = self.open.get(name, 0) + 1
        self.content += content
        self.hidden += hidden
        self.hinted += furniture == 1
        self.named += furniture == 2

    def pop_to(self, size: int) -> None:
        while len(self.stack) > size:
            name, content, furniture, hidden = self.stack.pop()
            self.hidden -= hidden
            self.open[name] -= 1
            self.content -= content
            self.hinted -= furniture == 1
            self.named -= furniture == 2
        while self.block_at and self.block_at[-1] >= size:
            self.block_at.pop()

    def close(self, name: str) -> None:
        if self.open.get(name):
            at = len(self.stack) - 1
            while self.stack[at][0] != name:
                at -= 1
            self.pop_to(at)

    def close_implied(self, name: str) -> None:
        """A new block ends an open paragraph, and an item the item before it, if nothing but inline elements lies between."""
        if self.block_at and self.stack[self.block_at[-1]][0] in _ENDED_BY.get(name, {"p"}):
            self.pop_to(self.block_at[-1])

    def start(self, name: str, attrs: str) -> None:
        content = name in CONTENT_TAGS
        furniture = 2 if name in FURNITURE_TAGS else 0
        if name == "header":  # an article's own header holds its title: its blocks are judged one by one
            furniture = 1 if self.content else 2
        if attrs and name not in ("html", "body", "a"):
            for m in _ATTR.finditer(attrs):
                grade, article = furniture_of(m[2] or m[3] or m[4] or "")
                furniture = max(furniture, grade)
                content |= article
        self.push(name, content and not furniture, furniture, bool(attrs) and name not in ("html", "body") and is_hidden(attrs))


def _tag_end(page: str, at: int, none_left: set[str]) -> int:
    """Position of the '>' that ends the tag whose name ends at ``at``, -1 if the page breaks off inside it."""
    while True:
        m = _STOP.search(page, at)
        if m is None:
            return -1
        if m[1] is None:
            return m.start()
        at = m.end()
        if m[1] not in none_left:
            closing = page.find(m[1], at)
            if closing < 0:
                none_left.add(m[1])
            else:
                at = closing + 1


def blocks_of(page: str) -> list[Block]:
    """The text blocks in page order. Unfinished tags and comments at the end of a page are dropped."""
    state, at, none_left = _Page(), 0, set()
    while True:
        lt = page.find("<", at)
        if lt < 0:
            state.add(page[at:])
            break
        after = page[lt + 1 : lt + 2]
        closing = after == "/" and page[lt + 2 : lt + 3].isascii() and page[lt + 2 : lt + 3].isalpha()
        if not (closing or after in ("!", "?") or (after == "/" and page[lt + 2 : lt + 3] == ">") or (after.isascii() and after.isalpha())):
            if lt + 1 == len(page) or page[lt + 1 :] == "/":  # a tag broken off by the end of the page
                state.add(page[at:lt])
                break
            state.add(page[at : lt + 1])
            at = lt + 1
            continue
        state.add(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if after in ("!", "?") or not (closing or after.isalpha()):
            end = page.find(">", lt)
            at = len(page) if end < 0 else end + 1
            continue
        name_at = _NAME.match(page, lt + 1 + closing)
        name = name_at.group().lower()
        end = _tag_end(page, name_at.end(), none_left)
        if end < 0:
            break
        attrs = page[name_at.end() : end]
        at = end + 1
        if name == "br":
            state.parts.append(" ")
            continue
        if closing:
            if name not in INLINE:
                state.flush()
            state.close(name)
            continue
        if name in RAW:
            if name not in INLINE:
                state.flush()
            stop = _RAW_END[name].search(page, at)
            if not stop:
                break
            gt = page.find(">", stop.start())
            at = len(page) if gt < 0 else gt + 1
            continue
        if name not in INLINE:
            state.flush()
            state.close_implied(name)
        if name not in VOID and not (attrs.endswith("/") and name in INLINE):
            state.start(name, attrs)
    state.flush()
    return state.blocks


def features(blocks: list[Block]) -> list[list[float]]:
    """One row of FEATURES for each block; before the first and after the last stand empty blocks."""
    has_content = any(b.in_content and b.furniture < 2 for b in blocks)
    size = [0, *(b.words for b in blocks), 0]
    density = [0.0, *(b.link_density for b in blocks), 0.0]
    return [
        [b.words, b.link_density, size[k], density[k], size[k + 2], density[k + 2], (2.0 if b.in_content else 0.0) if has_content else 1.0, float(b.furniture), float(b.heading)]
        for k, b in enumerate(blocks)
    ]
