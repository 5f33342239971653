"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags (inline tags and single line breaks are
white space or nothing). Each block has its word count and link density, those of its
two neighbours, and whether it stands in a heading, in page furniture (menu, header,
footer, sidebar, form, hidden), under a class, role or id that names such things (for sure or perhaps), and in an article.
A form, fieldset or dialog that wraps the page is no furniture: one with an article in it or, on a page
without any, with more than half of the page's free text. Articles of a few words without an ``h1`` beside
far more free text are teasers: such a page counts as one without an article.
A decision tree trained on ``LABELLED`` (in every place of a page) says which blocks are main text, another one
says so of blocks under names that only may mean furniture; they are joined in page order by line feeds.

Null, empty and broken markup gives what can be read, at worst an empty text; repeated
pages are read each on their own, an empty table gives an empty one, and an earlier column
of the name of the result is replaced. Markup is scanned once, in time linear in its length.
Inline elements with ``hidden`` are not tracked and stay text.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from jobspectra.llm.words import annotate

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|</?[a-zA-Z](?:[^>\"'<]|\"[^\"<]*+\"|'[^'<]*+')*+>|</?[a-zA-Z][^<>]*+>"
    r"|<(?:script|style|title|textarea|iframe|button|math|noscript|object|select|svg|template)(?=[\s/>])[^>]*+>|<[!?/][^>]*+>", re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BREAKS = re.compile(r"(?:\s*\0){2,}\s*")

# Of these everything up to the end tag is raw text, or to the end of the page without one.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in ("script", "style", "title", "textarea", "iframe")}
# These are no text either, but elements: without an end tag of their own they end with the
# element around them, and what they held is text of the page.
_NO_TEXT = frozenset("button math noscript object select svg template".split())
_NO_TEXT_END = re.compile(r"</(button|math|object|select|svg|template)(?=[\s/>])", re.I)
_NOSCRIPT = re.compile(r"<(/?)noscript(?=[\s/>])[^>]*+(?:>|\Z)", re.I)
_FOREIGN = frozenset(("svg", "math"))
# Elements in svg and math that hold HTML again; elsewhere these start tags end svg and math.
_HTML_INSIDE = frozenset("foreignobject desc annotation-xml".split())
_ENDS_FOREIGN = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 head hr li listing menu ol p pre table ul".split())

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small "
                   "span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FURNITURE = frozenset("nav aside footer menu".split())
# Furniture too, unless they wrap the page.
_WRAPPERS = frozenset("form dialog fieldset".split())
_QUOTED = re.compile(r"\"[^\"]*+\"|'[^']*+'")
_HIDDEN = re.compile(r"\shidden(?=[\s/>]|=(?!\s*until-found))", re.I)
_UNSEEN = re.compile(r"\sstyle\s*=\s*(?:\"[^\"]*?|'[^']*?)\b(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
# Free text of a page is judged by blocks of at least this many words, fewer than half of them linked.
_LONG = 11
# Articles with fewer words than this, and a fifth of the free text beside them, are teasers.
_TEASER = 40
_ARTICLE_HINT = re.compile(r"(?:^|[\s_-])(?:article(?:body)?|articlebody|post(?:-?body|-?content)?|entry(?:-content)?|main(?:-content)?|story|content)(?:$|[\s_-])", re.I)
# A whole class, role or id names page furniture if it is one of these words, or several of
# them with words for places and shapes. WEAK words also name parts of articles, so the
# tree weighs them against the block's words and links; the STRONG ones decide alone.
_STRONG = re.compile(r"ads?|advert\w*|adbox|sponsor\w*|promo\w*|sidebar\w*|nav(?:bar|igation|list|box|menu|links?)?|menu\w*|breadcrumbs?|footer\w*|masthead|cookies?|consent|gdpr|"
           r"popup|modal|overlay|newsletter|subscri\w*|signup|login|share\w*|sharing|social\w*|comments?|respond|reply|replies|disqus|pagination|pager|toolbar|"
           r"contentinfo|complementary")
_WEAK = re.compile(r"banner\w*|side|header|notice|alert|search|related|recommend\w*|respon[ds]\w*|widget\w*|tags?|dialog|copyright|legal")
_PLACE = re.compile(r"site|page|top|bottom|left|right|upper|lower|main|primary|secondary|global|mobile|sticky|fixed|box|bar|block|area|section|list|item|items|wrap|wrapper|"
          r"container|inner|outer|holder|panel|links?|buttons?|icons?|form|row|col|group|posts?|articles?|stories|slot|unit|\d+")

# By HTML's rules a start tag of these ends an open <p>, and an end tag reaches no further out than a boundary.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup "
                    "h1 h2 h3 h4 h5 h6 hr li dd dt listing main menu nav ol p plaintext pre search section summary table ul xmp".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BOUNDARY = frozenset("applet caption html marquee object table td template th".split())
_PART_OF_TABLE = {"caption": "caption colgroup tbody thead tfoot tr td th", "colgroup": "caption colgroup tbody thead tfoot tr td th",
                  "tbody": "caption colgroup tbody thead tfoot tr td th", "tr": "caption colgroup tr td th", "td": "td th"}
_PART_OF_TABLE = {k: frozenset(v.split()) for k, v in _PART_OF_TABLE.items()}
_PART_OF_TABLE |= {"thead": _PART_OF_TABLE["tbody"], "tfoot": _PART_OF_TABLE["tbody"], "th": _PART_OF_TABLE["td"]}
# A new list item looks for the one it ends no further out than to one of these.
_STOPS_ITEM = frozenset("applet article aside blockquote body button caption center colgroup dd details dir dl dt fieldset figcaption figure footer form "
                        "h1 h2 h3 h4 h5 h6 head header hgroup html li listing main marquee menu nav noembed noframes object ol plaintext pre search section "
                        "select summary table tbody td template tfoot th thead tr ul xmp".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "hint", "article", "heading", "article_on_page", "long_on_page")

# Labelled blocks: words, link density in percent, the same of the block before and of the
# block after, whether it is a heading; then 1 for main text if it stands in an article,
# and if the page has no article but long blocks.
LABELLED = (
    (60, 0, 8, 0, 80, 0, 0, 1, 1), (25, 0, 30, 0, 30, 0, 0, 1, 1), (120, 5, 3, 100, 60, 0, 0, 1, 1), (200, 0, 2, 0, 9, 0, 0, 1, 1),
    (15, 0, 60, 0, 50, 0, 0, 1, 1), (12, 10, 80, 0, 5, 0, 0, 1, 1), (45, 25, 30, 0, 4, 0, 0, 1, 1), (90, 3, 90, 3, 0, 0, 0, 1, 1),
    (30, 0, 2, 100, 2, 100, 0, 1, 1), (22, 0, 0, 0, 0, 0, 0, 1, 1), (35, 0, 1, 100, 40, 0, 0, 1, 1), (18, 0, 7, 0, 25, 0, 0, 1, 1),
    (11, 0, 25, 0, 0, 0, 0, 1, 1), (400, 0, 300, 0, 200, 0, 0, 1, 1), (14, 0, 14, 0, 14, 0, 0, 1, 1), (50, 8, 6, 0, 6, 0, 0, 1, 1),
    (8, 0, 70, 0, 90, 0, 0, 1, 1), (5, 0, 30, 0, 25, 0, 0, 1, 1), (3, 0, 50, 0, 60, 0, 0, 1, 1), (7, 0, 40, 0, 22, 0, 0, 1, 1),
    (1, 0, 28, 0, 35, 0, 0, 1, 1), (6, 20, 45, 0, 55, 0, 0, 1, 1),
    (6, 0, 2, 100, 70, 0, 1, 1, 1), (4, 0, 40, 0, 45, 0, 1, 1, 1), (3, 0, 2, 100, 20, 0, 1, 1, 1), (5, 0, 15, 0, 15, 0, 1, 1, 1),
    (9, 0, 0, 0, 40, 0, 1, 1, 1), (4, 0, 3, 0, 12, 0, 1, 1, 1), (2, 0, 90, 0, 3, 0, 1, 1, 1), (12, 0, 6, 0, 130, 0, 1, 1, 1),
    (4, 0, 1, 100, 25, 0, 1, 1, 1), (3, 0, 0, 0, 35, 0, 1, 1, 1), (6, 0, 1, 100, 18, 0, 1, 1, 1), (5, 0, 1, 100, 60, 0, 1, 1, 1),
    (2, 0, 3, 0, 2, 0, 0, 1, 0), (5, 0, 2, 100, 3, 0, 0, 1, 0), (3, 0, 2, 100, 2, 100, 0, 1, 0), (4, 0, 1, 100, 0, 0, 0, 1, 0),
    (6, 0, 3, 100, 5, 100, 0, 1, 0), (1, 0, 4, 0, 6, 0, 0, 1, 0), (7, 0, 60, 0, 0, 0, 0, 1, 0), (4, 0, 40, 0, 2, 0, 0, 1, 0),
    (5, 0, 1, 100, 45, 0, 0, 1, 0), (2, 0, 0, 0, 30, 0, 0, 1, 0), (8, 0, 8, 0, 8, 0, 0, 1, 0),
    (2, 100, 0, 0, 2, 100, 0, 0, 0), (5, 100, 60, 0, 4, 100, 0, 1, 0), (3, 100, 3, 100, 3, 100, 0, 0, 0), (8, 90, 80, 0, 8, 90, 0, 1, 0),
    (4, 100, 6, 100, 70, 0, 0, 0, 0), (30, 90, 4, 100, 30, 90, 0, 1, 0), (18, 75, 60, 0, 18, 75, 0, 1, 0), (6, 100, 50, 0, 60, 0, 0, 1, 0),
    (1, 100, 1, 100, 120, 0, 0, 0, 0), (10, 80, 25, 0, 30, 0, 0, 1, 0), (2, 100, 40, 0, 0, 0, 1, 0, 0),
    (5, 100, 5, 100, 6, 100, 0, 1, 0), (9, 100, 7, 100, 8, 100, 0, 1, 0), (7, 100, 1, 0, 0, 0, 0, 1, 0), (15, 100, 12, 100, 20, 100, 0, 1, 0),
    (1, 100, 2, 100, 1, 100, 0, 0, 0), (4, 100, 30, 0, 0, 0, 0, 0, 0), (4, 100, 4, 100, 4, 100, 0, 0, 0), (3, 100, 60, 0, 80, 0, 0, 0, 0),
    (4, 100, 40, 0, 60, 0, 1, 1, 1), (7, 100, 20, 0, 35, 0, 1, 1, 1), (2, 100, 90, 0, 45, 0, 1, 1, 1),
)


def examples(weak: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The labelled blocks in every place: in furniture or under its strong names they are
    never main text, nor outside of the article of a page that has one. On a page without
    any long block all unlinked ones are. Under its weak names they are if they are long enough, or a heading before a long block, and have few links."""
    rows = []
    for *numbers, heading, in_article, alone in LABELLED:
        if weak:
            words, links, _, _, words_after, links_after = numbers
            size = (words_after if links_after < 50 else 0) if heading else words
            main = in_article and links < 30 and size >= 12
            places = ((1, 0.5, 0, 0, 1, 0), (1, 0.5, 0, 1, 1, 0), (1, 0.5, 1, 1, 1, 0), (0, 0.5, 0, 1, 1, 0), (0, 0.5, 1, 1, 1, main),
                      (0, 0.5, 0, 0, 1, main and alone and size >= 30))
        else:
            places = ((1, 0, 0, 0, 1, 0), (1, 0, 0, 1, 1, 0), (1, 0, 1, 1, 1, 0), (0, 1, 0, 0, 1, 0), (0, 1, 0, 1, 1, 0), (0, 1, 1, 1, 1, 0), (1, 1, 0, 0, 1, 0),
                      (1, 0, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0), (0, 0, 0, 1, 1, 0), (0, 0, 1, 1, 1, in_article), (0, 0, 0, 0, 1, alone), (0, 0, 0, 0, 0, numbers[1] < 50))
        for furniture, hint, article, page, long, label in places:
            for words in {numbers[0], 1, 20} if weak and heading else {numbers[0]}:  # a heading may be short or long
                rows.append((words, *numbers[1:], furniture, hint, article, heading, page, long, label))
    table_ = np.array(rows, float)
    return table_[:, :-1], table_[:, -1]


@lru_cache(maxsize=4096)
def _kinds(tag: str) -> tuple[str, ...]:
    """The lists of open positions an element is held in."""
    return (tag, *["*boundary"] * (tag in _BOUNDARY), *["*heading"] * (tag in _HEADINGS), *["*stop"] * (tag in _STOPS_ITEM),
            *["*foreign"] * (tag in _FOREIGN), *["*html"] * (tag in _HTML_INSIDE))


class Open:
    """Open elements of a page. The last position of every name is known, so that each tag
    opens or ends elements in constant time for every element opened, at any depth."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[int, float, int, int, int]]] = []
        self.at: dict[str, list[int]] = {}
        self.page = (0, 0, 0, 0, 0)  # outside of all of them

    def last(self, *kinds: str) -> int:
        return max([self.at[k][-1] for k in kinds if self.at.get(k)], default=-1)

    def cut(self, depth: int) -> None:
        """End the element at this position and all in it."""
        while len(self.stack) > depth:
            for kind in _kinds(self.stack.pop()[0]):
                self.at[kind].pop()

    def push(self, tag: str, state: tuple[int, float, int, int, int]) -> None:
        for kind in _kinds(tag):
            self.at.setdefault(kind, []).append(len(self.stack))
        self.stack.append((tag, state))

    def state(self) -> tuple[int, float, int, int, int]:
        return self.stack[-1][1] if self.stack else self.page

    def foreign(self) -> bool:
        """Whether this place is in svg or math, and not in HTML within them."""
        return self.last("*foreign") > self.last("*html")

    def ended(self, tag: str) -> int | None:
        """Position of the element an end tag ends: the innermost of its name, unless a boundary lies between."""
        if tag in _HEADINGS:
            depth, limit = self.last("*heading"), self.last("*boundary")
        elif tag in _PART_OF_TABLE or tag == "table":
            depth, limit = self.last(tag), self.last("template") if tag in ("table", "template") else self.last("table", "template")
        elif tag in _FOREIGN:
            depth, limit = self.last(tag), -1
        else:
            depth = self.last(tag)
            limit = self.last("*boundary", *("ol", "ul") * (tag == "li"), *("button",) * (tag == "p"))
        return depth if depth >= 0 and depth >= limit else None

    def make_room(self, tag: str) -> bool:
        """End what a start tag ends by itself; False if the element cannot stand here."""
        while tag in _ENDS_FOREIGN and self.foreign():
            self.cut(self.last("*foreign"))
        if tag in ("li", "dd", "dt"):
            depth = self.last("*stop")
            if depth >= 0 and (self.stack[depth][0] == tag or tag != "li" and self.stack[depth][0] in ("dd", "dt")):
                self.cut(depth)
        elif tag in _PART_OF_TABLE:
            table_, others = self.last("table"), self.last("template")
            if table_ < 0 and others < 0:
                return False
            inside = [d for d in (self.last(t) for t in _PART_OF_TABLE[tag]) if d > max(table_, others)]
            if inside:
                self.cut(min(inside))
        elif tag in ("option", "optgroup"):
            for ended in ("option", "optgroup")[:1 + (tag == "optgroup")]:
                if self.stack and self.stack[-1][0] == ended:
                    self.cut(len(self.stack) - 1)
        if tag in _ENDS_P:
            depth = self.last("p")
            if depth > self.last("*boundary", "button"):
                self.cut(depth)
        if tag in _HEADINGS and self.stack and self.stack[-1][0] in _HEADINGS:
            self.cut(len(self.stack) - 1)
        return True


class Block:
    __slots__ = ("text", "words", "links", "furniture", "hint", "article", "heading", "wrapper")


def _space(pieces: list[str]) -> list[str]:
    """White space of a block as one space; two line breaks or more part it."""
    text = "".join(pieces)
    parts = _BREAKS.split(text) if text.count("\0") > 1 else [text]
    found = (" ".join(html.unescape(p.replace("\0", " ")).split()) for p in parts)
    return [p for p in found if p]


def _names(tag: str) -> list[str]:
    """Values of class, role, id and itemprop."""
    return [v for _, *a in _ATTR.findall(tag) for v in a if v] if "=" in tag else []


def _article_hint(names: list[str]) -> bool:
    return any(_ARTICLE_HINT.search(n) for n in names)


@lru_cache(maxsize=4096)
def _furniture_hint(names: str) -> float:
    """1 under a strong name of page furniture, 0.5 under a weak one."""
    hint = 0.0
    for name in names.split():
        parts = [p for p in re.split("[_-]+", name.lower()) if p]
        strong = [bool(_STRONG.fullmatch(p)) for p in parts]
        weak = [bool(_WEAK.fullmatch(p)) for p in parts]
        if parts[:1] == ["comment"] or all(s or w or _PLACE.fullmatch(p) for p, s, w in zip(parts, strong, weak)):
            hint = max(hint, 1.0 if any(strong) else 0.5 if any(weak) else 0.0)
    return hint


def _hidden(tag: str) -> bool:
    """Whether a start tag hides its element, by the attribute or by its style."""
    lower = tag.lower()
    return "hidden" in lower and bool(_HIDDEN.search(_QUOTED.sub(lambda q: q.group()[1:-1] if q.group()[1:-1].lower() == "until-found" else "", tag))) \
        or "style" in lower and bool(_UNSEEN.search(tag))


def _free(b: Block) -> bool:
    return not b.furniture and b.hint == 0 and b.links < 0.5


def _settle(found: list[Block], wrappers: list[list[int]], titled: bool) -> None:
    """Decide what needs the whole page: which forms are furniture, and whether its articles are teasers.

    ``wrappers`` holds the wrapper around each one, and whether an article begins in it; number 0 is the page.
    """
    text = [0] * len(wrappers)
    for b in found:
        if _free(b) and b.words >= _LONG:
            text[b.wrapper] += b.words
    for k in range(len(wrappers) - 1, 0, -1):
        text[wrappers[k][0]] += text[k]
        wrappers[wrappers[k][0]][1] |= wrappers[k][1]
    furniture = [False] * len(wrappers)
    any_article = any(b.article for b in found)
    for k, (around, holds) in enumerate(wrappers[1:], 1):
        furniture[k] = furniture[around] or not (holds or not any_article and 2 * text[k] > text[0])
    for b in found:
        b.furniture = int(b.furniture or furniture[b.wrapper])
    inside = sum(b.words for b in found if b.article and not b.furniture and b.hint < 1)
    beside = sum(b.words for b in found if not b.article and not b.heading and b.words >= _LONG and _free(b))
    if any_article and not titled and inside < _TEASER and 5 * inside < beside:
        for b in found:
            b.article = 0


def blocks(page: str | None) -> list[Block]:
    """Text blocks of a page in order."""
    out: list[Block] = []
    elements = Open()
    pieces: list[str] = []
    linked: list[str] = []
    state = elements.state()  # furniture, hint, article, heading, wrapper
    wrappers = [[0, 0]]  # the one around it, and whether an article begins in it
    titled = False  # an article has an h1
    anchors = 0
    before: dict[int, tuple] = {}  # what there was before an element without text, by its position
    last_ends: dict[str, int] | None = None

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            found = _space(pieces)
            in_links = len(html.unescape("".join(linked)).split())
            total = sum(len(t.split()) for t in found) or 1
            for text in found:
                b = Block()
                b.text, b.words = text, len(text.split())
                b.links = min(1.0, in_links / total)
                b.furniture, b.hint, b.article, b.heading, b.wrapper = state
                out.append(b)
            pieces, linked = [], []  # the old ones may come back

    def say(text: str) -> None:
        if text:
            pieces.append(text)
            if anchors:
                linked.append(text + " ")

    page, at = (page or "").replace("\0", ""), 0
    while m := _TOKEN.search(page, at):
        say(page[at:m.start()])
        at = m.end()
        name = _NAME.match(page, m.start())
        if not name:
            continue
        tag = name.group(1).lower()
        closing = page[m.start() + 1] == "/"
        if tag in _RAW or tag in _NO_TEXT or m.group().endswith("/>"):
            empty = m.group().endswith("/>") and (tag in _FOREIGN or elements.foreign())
            if empty:
                continue
            if tag in _RAW:
                if not closing:
                    end = _RAW[tag].search(page, at)
                    at = end.end() if end else len(page)
                continue
            if tag == "noscript":
                end = None if closing else _NOSCRIPT.search(page, at)
                if end and end.group(1):
                    at = end.end()
                continue
        if tag in _NO_TEXT:
            if closing:
                depth = elements.ended(tag)
                if depth is not None:
                    n_out, pieces, n_pieces, linked, n_linked, anchors = before[depth]
                    del out[n_out:], pieces[n_pieces:], linked[n_linked:]
                    elements.cut(depth)
                    state = elements.state()
                continue
            if last_ends is None:
                last_ends = {e.group(1).lower(): e.start() for e in _NO_TEXT_END.finditer(page, at)}
            if last_ends.get(tag, -1) >= at:
                depth = elements.ended(tag) if tag in ("button", "select") else None
                if depth is not None:
                    flush()
                    elements.cut(depth)
                before[len(elements.stack)] = len(out), pieces, len(pieces), linked, len(linked), anchors
                elements.push(tag, elements.state())
                state = elements.state()
            continue
        if tag == "a":
            anchors = 0 if closing else 1
            continue
        if tag == "br":
            pieces.append("\0")
            continue
        if tag in INLINE:
            continue
        flush()
        anchors = 0
        if tag in VOID or tag in ("html", "body"):
            if tag == "hr" and not closing:
                elements.make_room(tag)
            elif tag in ("html", "body") and not closing:
                if tag == "body" and elements.stack and elements.stack[-1][0] == "head":
                    elements.cut(len(elements.stack) - 1)
                if _article_hint(_names(m.group())):
                    elements.page = (0, 0, 1, 0, 0)
        elif closing:
            depth = elements.ended(tag)
            if depth is not None:
                elements.cut(depth)
        elif elements.make_room(tag):
            names = _names(m.group()) if tag not in _HEADINGS else []
            furniture, hint, article, heading, wrapper = elements.state()
            begins = not article and (tag in ("article", "main") or _article_hint(names))
            article = int(article or begins)
            titled = titled or bool(article and tag == "h1")
            furniture = int(furniture or tag in FURNITURE or (tag == "header" and not article) or _hidden(m.group()))
            if tag in _WRAPPERS:
                wrappers.append([wrapper, 0])
                wrapper = len(wrappers) - 1
            elif begins and not furniture:
                wrappers[wrapper][1] = 1
            if tag not in ("article", "main"):
                hint = max(hint, _furniture_hint(" ".join(names))) if names else hint
            elements.push(tag, (furniture, hint, article, int(heading or tag in _HEADINGS), wrapper))
        state = elements.state()
    say(page[at:] if not re.match(r"<[a-zA-Z/!?][^>]*\Z", page[at:]) else "")
    flush()
    _settle(out, wrappers, titled)
    return out


def table(found: list[Block]) -> np.ndarray:
    """Features of the blocks of a page, one row each."""
    own = np.array([(b.words, 100 * b.links) for b in found], float).reshape(-1, 2)
    none = np.zeros((1, 2))
    rest = np.array([(b.furniture, b.hint, b.article, b.heading) for b in found], float).reshape(-1, 4)
    article = any(b.article for b in found)
    page = np.tile((article, article or any(b.words >= _LONG and _free(b) for b in found)), (len(found), 1)).astype(float)
    return np.hstack([own, np.vstack([none, own[:-1]]), np.vstack([own[1:], none]), rest, page]) if len(found) else np.zeros((0, len(FEATURES)))


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9) -> tuple | float:
    """Decision tree by Gini impurity: (feature, limit, at most, above) or a share of main text."""
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = None
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, j] <= limit
            a, b = y[low], y[~low]
            impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, j, limit, low)
    if best is None:
        return float(y.mean())
    _, j, limit, low = best
    return j, float(limit), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@lru_cache(maxsize=2)
def tree(weak: bool = False) -> tuple:
    return grow(*examples(weak))


def classify(rows: np.ndarray, node: tuple | float) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(rows), node >= 0.5)
    j, limit, low, high = node
    left = rows[:, j] <= limit
    out = np.zeros(len(rows), bool)
    out[left], out[~left] = classify(rows[left], low), classify(rows[~left], high)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page)
    rows = table(found)
    keep, weak = classify(rows, tree()), rows[:, FEATURES.index("hint")] == 0.5
    if weak.any():
        keep[weak] = classify(rows[weak], tree(True))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Add the main text of each page, read from its whole markup."""
    return annotate(pages, html_col, [T.StructField(text_col, T.StringType())], lambda values: [[main_text(v) for v in values]])
