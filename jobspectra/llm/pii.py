"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Base kinds (email, ip, card, phone) are always kept once their own check holds; other
kinds (bank account numbers by the mod-97 check, secrets, national phone numbers) are
kept from ``THRESHOLD`` on. A span's score starts from its kind, gains by a checksum and
by words nearby that name such data, and loses by words that name something else.

Positions are code points, ends exclusive. Spans come in the order of start, then kind.
Whole texts are scanned, in time that grows with their length (times its logarithm for
the order of spans). Null and empty texts have no spans; no row is shuffled or dropped,
repeated rows are read each on their own, an empty table gives an empty one, and an earlier
column of the name of the result is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobspectra.llm.words import annotate

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret", "local_phone")
THRESHOLD = 0.6
WINDOW = 40

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                  T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_SECRET = re.compile(r"\b(?:api[_ -]?key|access[_ -]?key|auth[_ -]?token|token|secret|password|passwd|pwd)\b\s{0,3}[:=]\s{0,3}[\"']?([^\s\"']{8,})", re.I)
_LOCAL_PHONE = re.compile(r"(?<![0-9+.])\(?0?[0-9]{2,4}\)?[ /.-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")

START = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.4, "secret": 0.6, "local_phone": 0.3}
CHECKED = {"card": 0.3, "iban": 0.4}
NAMES = {
    "email": re.compile(r"mail|contact|write", re.I), "ip": re.compile(r"\bip\b|address|host|server", re.I),
    "card": re.compile(r"card|visa|credit|debit|payment", re.I), "phone": re.compile(r"phone|\btel\b|call|mobile|fax", re.I),
    "iban": re.compile(r"iban|account|bank", re.I), "secret": re.compile(r"key|token|login", re.I),
    "local_phone": re.compile(r"phone|\btel\b|call|mobile|fax", re.I),
}
OTHERS = re.compile(r"version|isbn|order no|invoice|serial|example|sample", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _ips(text: str):
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, at = run.group().split("."), run.start()
        for k in range(0, len(parts) - len(parts) % 4, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(q) <= 3 and int(q or 0) <= 255 for q in (p.lstrip("0") for p in four)):
                yield at, end
            at = end + 1


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                yield m.span()


def _ibans(text: str):
    for m in _IBAN.finditer(text):
        account = m.group().replace(" ", "")
        if 15 <= len(account) <= 34 and mod97(account):
            yield m.span()


_FIND = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans,
         "secret": lambda text: (m.span(1) for m in _SECRET.finditer(text)),
         "local_phone": lambda text: (m.span() for m in _LOCAL_PHONE.finditer(text))}


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All kept spans of a text: (kind, start, end, score)."""
    found = []
    for kind in KINDS if text else ():
        for start, end in _FIND[kind](text):
            near = text[max(0, start - WINDOW):start] + " " + text[end:end + WINDOW]
            score = START[kind] + CHECKED.get(kind, 0.0)
            score += 0.3 * bool(NAMES[kind].search(near)) - 0.3 * bool(OTHERS.search(near))
            score = round(min(1.0, max(0.0, score)), 2)
            if kind in BASE_KINDS or score >= THRESHOLD:
                found.append((kind, start, end, score))
    # A national number inside another span is that span.
    taken = sorted((a, b) for k, a, b, _ in found if k != "local_phone")
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    kept = []
    for s in found:
        before = bisect_left(starts, s[2])  # spans that start before its end; one of them overlaps if any reaches past its start
        if s[0] != "local_phone" or not before or reach[before - 1] <= s[1]:
            kept.append(s)
    return sorted(kept, key=lambda s: (s[1], KINDS.index(s[0])))


def redacted(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, end, _ in spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Add the array of spans with kind, start, end and score."""

    def run(values: list) -> list[list]:
        return [[[dict(zip(("kind", "start", "end", "score"), s)) for s in spans(v)] for v in values]]

    return annotate(docs, text_col, [T.StructField(spans_col, SPANS)], run)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace the spans in the text column; column order stays."""

    def run(values: list) -> list[list]:
        return [[redacted(v) for v in values]]

    hidden = annotate(docs.withColumn("_raw_text", F.col(text_col)).drop(text_col), "_raw_text", [T.StructField(text_col, T.StringType())], run)
    return hidden.select(docs.columns)


def joined(spans_: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_only(spans_: Column) -> Column:
    return F.filter(spans_, lambda s: s["kind"].isin(*BASE_KINDS))


def count(spans_: Column, kind: str) -> Column:
    return F.size(F.filter(spans_, lambda s: s["kind"] == kind)).cast("long")
