"""Which terms of a dictionary occur in a text, in one regex pass per text and 2000 terms.

A lookahead finds the longest term at every position without consuming it, so
overlapping terms are all seen. A shorter term that begins at the same position is a
prefix of the longest one, which a fixed table settles. Dictionaries are curated
configuration, not data, but of any size.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of one pattern; a larger dictionary takes several passes.
TERMS_PER_PASS = 2000


def _quote(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def _pattern(terms: Sequence[str], whole_words: bool) -> str:
    """Longer terms first, grouped by first character, and the characters in chunks that
    a character class admits: a failed position costs a handful of tests instead of one
    per term."""
    groups: dict[str, list[str]] = {}
    for term in sorted(terms, key=len, reverse=True):
        groups.setdefault(term[0], []).append(_quote(term[1:]))
    heads = sorted(groups)
    size = max(1, round(len(heads) ** 0.5))
    chunks = []
    for i in range(0, len(heads), size):
        part = heads[i:i + size]
        options = "|".join(f"{_quote(h)}(?:{'|'.join(groups[h])})" for h in part)
        chunks.append(f"(?=[{''.join(map(_quote, part))}])(?:{options})")
    body, first = "|".join(chunks), f"(?=[{''.join(map(_quote, heads))}])"
    return rf"(?U){first}\b(?=({body})\b)" if whole_words else f"(?s){first}(?=({body}))"


def _prefixes(terms: Sequence[str]) -> dict[str, list[int]]:
    places: dict[str, list[int]] = {}
    for i, term in enumerate(terms):
        places.setdefault(term, []).append(i)
    return places


def _implied(longest: str, places: dict[str, list[int]], whole_words: bool) -> list[int]:
    end = r"\b" if whole_words else ""
    heads = (longest[:k] for k in range(1, len(longest) + 1))
    return sorted(i for h in heads if h in places and (h == longest or re.match(re.escape(h) + end, longest)) for i in places[h])


def occurring(text: Column, terms: Sequence[str], whole_words: bool) -> Column:
    """Sorted positions (in ``terms``) of the lower-case terms found in a lower-case text."""
    unique = list(dict.fromkeys(terms))
    if not unique:
        return F.array().cast("array<int>")
    passes = [_pass(text, unique[i:i + TERMS_PER_PASS], terms, whole_words) for i in range(0, len(unique), TERMS_PER_PASS)]
    return F.array_sort(F.array_distinct(passes[0] if len(passes) == 1 else F.concat(*passes)))


def _pass(text: Column, unique: Sequence[str], every: Sequence[str], whole_words: bool) -> Column:
    mine = set(unique)
    places = [i for i, t in enumerate(every) if t in mine]
    terms = [every[i] for i in places]
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(_pattern(unique, whole_words)), 1))
    prefixes = _prefixes(terms)
    sql = ", ".join(f"{sql_text(t)}, array({', '.join(str(places[i]) for i in _implied(t, prefixes, whole_words))})" for t in unique)
    table = F.expr(f"map({sql})")
    return F.flatten(F.transform(found, lambda t: F.try_element_at(table, t)))


def sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
