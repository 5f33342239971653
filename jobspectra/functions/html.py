"""Page rules: native columns for flat markup, and a small tree reader for nested pages."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: blocked-page rule and void elements ---------------------------------
BLOCKED_WORD = "captcha"
BLOCKED_MAX_LENGTH = 5000
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
             "source", "track", "wbr"}
# -------------------------------------------------------------------------------------


def is_blocked(html: Column) -> Column:
    """Captcha form or image present, or a short page that mentions the word."""
    element = rf'(?is)<(?:form|img)\b[^>]*\bclass\s*=\s*["\'][^"\'>]*{BLOCKED_WORD}'
    short = (F.length(html) < BLOCKED_MAX_LENGTH) & F.lower(html).contains(BLOCKED_WORD)
    return F.coalesce(short | html.rlike(element), F.lit(False))


def decode_entities(text: Column) -> Column:
    """The five predefined entities plus the non-breaking space."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def tag_text(html: Column, tag: str, attribute: str = "") -> Column:
    """Text of the first ``<tag>`` that does not nest in itself; NULL when there is none."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*{attribute}[^>]*>(.*?)</{tag}\s*>", 1)
    plain = F.regexp_replace(inner, r"\s*<[^>]*>\s*", "")
    return F.nullif(F.trim(decode_entities(plain)), F.lit(""))


def counter_value(text: Column) -> Column:
    """First number of a result counter, digits joined across spaces; 0 when missing."""
    joined = F.regexp_replace(text, r"[\x{a0}\x{202f}\x{2009} ]", "")
    return F.coalesce(F.nullif(F.regexp_extract(joined, r"(\d+)", 1), F.lit("")).try_cast("long"),
                      F.lit(0).cast("long"))


def links(html: Column, marker: str = "") -> Column:
    """``href`` values of the anchors whose tag holds ``marker``, in page order."""
    tags = F.regexp_extract_all(html, F.lit(rf"(?is)<a\b[^>]*{marker}[^>]*>"), 0)
    return F.transform(tags, lambda t: F.regexp_extract(t, r"""(?is)\bhref\s*=\s*["']([^"']*)["']""", 1))


class Rule:
    """Which elements feed a field: tag, attribute and how its value is compared."""

    def __init__(self, field: str, tag: str | None = None, attr: str | None = None,
                 value: str | None = None, contains: bool = False,
                 inside: str | None = None, take: str = "text") -> None:
        self.field, self.tag, self.attr, self.value = field, tag, attr, value
        self.contains, self.inside, self.take = contains, inside, take

    def matches(self, tag: str, attrs: dict) -> bool:
        if self.tag and tag != self.tag:
            return False
        if not self.attr:
            return True
        got = attrs.get(self.attr)
        if got is None:
            return False
        if self.contains:
            return self.value in got
        return self.value in (got.split() if self.attr == "class" else (got,))


class PageReader(HTMLParser):
    """Collects the text of elements selected by rules, nested tags included.

    ``found[field]`` lists one entry per matching element in document order; the own
    text of ``div`` elements is kept for ``own_prefix`` look-ups.
    """

    def __init__(self, rules: list[Rule], own_prefix: str | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.rules, self.own_prefix = rules, own_prefix
        self.found: dict[str, list[str]] = {r.field: [] for r in rules}
        self.inner: dict[int, list[str]] = {}
        self.prefixed: list[str] = []
        self._open: list[list] = []
        self._bare = [r for r in rules if not r.attr]

    def updatepos(self, i, j):
        """Lines and columns are not asked for, so they are not counted."""
        return j

    def handle_starttag(self, tag, attrs):
        attributes = {k: v or "" for k, v in attrs}
        captures = []
        for rule in self.rules if attrs else self._bare:
            if not rule.matches(tag, attributes):
                continue
            outer = [held for _, caps, _ in self._open for name, held in caps if name == rule.inside]
            if rule.inside and not outer:
                continue
            entry: list[str] = [attributes.get(rule.take[5:], "")] if rule.take.startswith("attr:") else []
            self.found[rule.field].append(entry)
            if outer:
                self.inner.setdefault(id(outer[-1]), entry)
            captures.append((rule.field, None if rule.take.startswith("attr:") else entry))
        own = ([], []) if self.own_prefix and tag == "div" else None
        if tag not in VOID_TAGS:
            self._open.append([tag, captures, own])

    def handle_endtag(self, tag):
        for depth in range(len(self._open) - 1, -1, -1):
            if self._open[depth][0] == tag:
                for _, _, own in reversed(self._open[depth:]):
                    self._close(own)
                del self._open[depth:]
                return

    def handle_data(self, data):
        piece = data.strip()
        if not piece:
            return
        for position, (_, captures, own) in enumerate(self._open):
            for _, entry in captures:
                if entry is not None:
                    entry.append(piece)
            if own is not None:
                own[0].append(piece)
                if position == len(self._open) - 1:
                    own[1].append(piece)

    def _close(self, own):
        if own is not None and "".join(own[1]).startswith(self.own_prefix):
            self.prefixed.append("".join(own[0]))

    def finish(self) -> dict[str, list[str]]:
        self.close()
        for _, _, own in reversed(self._open):
            self._close(own)
        return {field: ["".join(e) for e in entries] for field, entries in self.found.items()}

    def innermost(self, field: str) -> list[str]:
        """Per element of the field the text of the first element found inside it, else its own."""
        return ["".join(self.inner.get(id(e), e)) for e in self.found[field]]
