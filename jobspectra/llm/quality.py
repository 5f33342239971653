"""Quality rules as a short-circuit cascade.

A rule reads features of a text and rejects it or not. A bounded sample (``SAMPLE_ROWS``
texts) gives each rule's cost (seconds a text for the features it needs) and its
rejection rate; rules run in the order of rejections per second, and each one only on
the texts that no rule before it has rejected. The order never changes the verdict.

Nulls count as empty texts; an empty text has no words and fails ``too_few_words``.
Whole texts are read; nothing is shuffled.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from jobspectra.llm.words import Block, annotate, blocks, tabulate

SAMPLE_ROWS = 400
_BLANK = " \t\n\v\f\r"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LATIN = np.zeros(256, bool)
_LATIN[[b for b in range(256) if b >= 128 or chr(b).isalpha()]] = True
_LETTER = re.compile(r"[^\W\d_]")
_ENDS = re.compile(r"(?:\.\.\.|…)[ \t]*(?=\n|$)")


class Features:
    """Features of a block of texts, each computed once and only when a rule asks for it."""

    def __init__(self, texts: list[str], block: Block | None = None):
        self.texts, self.known, self._block = texts, {}, block

    @property
    def block(self) -> Block:
        if self._block is None:
            self._block = Block([t.encode("utf-8", "replace") for t in self.texts], False)
        return self._block

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known[name] = _FEATURES[name](self)
        return self.known[name]

    def some(self, rows: np.ndarray) -> Features:
        """Some of the texts, with what is known of them."""
        out = Features([self.texts[i] for i in rows])
        out.known = {k: v[rows] for k, v in self.known.items()}
        return out


def _lines(f: Features) -> np.ndarray:
    found = [[x for x in t.split("\n") if x.strip(_BLANK)] for t in f.texts]
    f.known["n_lines"] = np.array([len(x) for x in found], np.int64)
    return np.array([len(x) - len(set(x)) for x in found], np.int64)


def _repeat_words(f: Features) -> np.ndarray:
    block = f.block
    grams, at = block.ngrams(block.hashes(), 3)
    covered = np.zeros(len(block.starts), bool)
    if len(grams):
        keys = grams + block.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = True
    return np.bincount(block.doc[covered], minlength=block.n_docs)


def _alpha_words(f: Features) -> np.ndarray:
    block = f.block
    letters = np.concatenate(([0], np.cumsum(_LATIN[block.data])))
    has = letters[block.starts + block.lens] > letters[block.starts]
    return np.bincount(block.doc[has], minlength=block.n_docs)


def _capitals(f: Features) -> np.ndarray:
    """More capitals than small letters, both of ASCII, in a text whose letters are mostly ASCII."""
    upper, lower = f["n_upper"], f["n_lower"]
    bad = upper > lower
    for i in np.flatnonzero(bad):
        bad[i] = 2 * (upper[i] + lower[i]) > len(_LETTER.findall(f.texts[i]))
    return bad


_FEATURES: dict[str, Callable[[Features], np.ndarray]] = {
    "n_words": lambda f: f.block.n_words,
    "word_chars": lambda f: f.block.per_doc(~f.block.white & ((f.block.data & 0xC0) != 0x80)),
    "n_symbols": lambda f: f.block.per_doc(_SYMBOL[f.block.data]),
    "n_dup_lines": _lines,
    "n_lines": lambda f: (_lines(f), f.known["n_lines"])[1],
    "n_repeat_words": _repeat_words,
    "n_upper": lambda f: f.block.per_doc((f.block.data >= 65) & (f.block.data <= 90)),
    "n_lower": lambda f: f.block.per_doc((f.block.data >= 97) & (f.block.data <= 122)),
    "n_alpha_words": _alpha_words,
    "n_shouts": lambda f: f.block.per_doc(f.block.data == 33),
    "n_cut_lines": lambda f: np.array([len(_ENDS.findall(t)) for t in f.texts], np.int64),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps features to a flag per text; ``needs`` lists what it reads."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Features], np.ndarray]


# Limits follow published filters for web text (symbol, repetition, case and length rules).
RULES = (
    Rule("too_few_words", ("n_words",), lambda f: f["n_words"] < 50),
    Rule("repeats_itself", ("n_words", "n_repeat_words"), lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
    Rule("symbols", ("n_words", "n_symbols"), lambda f: 10 * f["n_symbols"] > f["n_words"]),
    Rule("copied_lines", ("n_lines", "n_dup_lines"), lambda f: 10 * f["n_dup_lines"] > 4 * f["n_lines"]),
    Rule("word_length", ("n_words", "word_chars"), lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 15 * f["n_words"])),
    Rule("capitals", ("n_upper", "n_lower"), _capitals),
    Rule("few_letters", ("n_words", "n_alpha_words"), lambda f: 10 * f["n_alpha_words"] < 7 * f["n_words"]),
    Rule("shouting", ("n_words", "n_shouts"), lambda f: 2 * f["n_shouts"] > f["n_words"]),
    Rule("cut_lines", ("n_lines", "n_cut_lines"), lambda f: 10 * f["n_cut_lines"] > 5 * np.maximum(f["n_lines"], 1)),
)


def cascade(features: Features, rules: tuple[Rule, ...], alive: np.ndarray | None = None) -> np.ndarray:
    """True for texts that no rule rejects; rejected texts are not shown to later rules."""
    kept = np.ones(len(features.texts), bool) if alive is None else alive.copy()
    rows = np.flatnonzero(kept)
    left = features if len(rows) == len(kept) else features.some(rows)
    for rule in rules:
        if not len(rows):
            break
        bad = rule.rejects(left)
        if bad.any():
            kept[rows[bad]] = False
            rows = rows[~bad]
            left = left.some(np.flatnonzero(~bad))
    return kept


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Cost and selectivity of each rule on a sample, best rejection per cost first.

    Only one row per rule comes to the driver. With no rows every rule gets rate 0 and
    the given order stays (ties keep it).
    """
    schema = T.StructType([T.StructField("rule", T.StringType()), T.StructField("seconds", T.DoubleType()),
                           T.StructField("rejected", T.LongType()), T.StructField("texts", T.LongType())])

    def measure(batches):
        seconds, rejected, n = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            n += len(texts)
            for lo, hi, block in blocks(texts, False):
                for k, rule in enumerate(rules):
                    fresh = Features(texts[lo:hi], block)
                    began = time.perf_counter()
                    rejected[k] += int(rule.rejects(fresh).sum())
                    seconds[k] += time.perf_counter() - began
        yield {"rule": [r.name for r in rules], "seconds": seconds, "rejected": rejected, "texts": [n] * len(rules)}

    rows = tabulate(docs.select(text_col).limit(sample_rows), schema, measure).collect()
    total: dict[str, list] = {r.name: [0.0, 0, 0] for r in rules}
    for row in rows:
        t = total[row["rule"]]
        t[0], t[1], t[2] = t[0] + row["seconds"], t[1] + row["rejected"], t[2] + row["texts"]
    measured = [{"rule": r.name, "cost": total[r.name][0] / max(total[r.name][2], 1),
                 "rate": total[r.name][1] / max(total[r.name][2], 1)} for r in rules]
    return sorted(measured, key=lambda m: -m["rate"] / max(m["cost"], 1e-9))


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    by_name = {r.name: r for r in rules}
    return tuple(by_name[m["rule"]] for m in plan(docs, rules, text_col, sample_rows))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", counts: bool = False,
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add ``kept``: no rule rejects the text. With ``counts`` also the base counts of
    every text and ``base_failed`` (too few words or mostly repeats)."""
    order = ordered(docs, rules, text_col, sample_rows)
    names = BASE if counts else ()
    fields = [T.StructField(n, T.LongType()) for n in names]
    fields += [T.StructField("base_failed", T.BooleanType())] * counts
    fields += [T.StructField("kept", T.BooleanType())]

    def run(values: list) -> list[list]:
        texts = [t or "" for t in values]
        out: list[list] = [[] for _ in fields]
        for lo, hi, block in blocks(texts, False):
            features = Features(texts[lo:hi], block)
            done = [features[n] for n in names]
            alive = None
            if counts:
                failed = (features["n_words"] < 50) | (100 * features["n_repeat_words"] > 50 * features["n_words"])
                done.append(failed)
                alive = ~failed
            done.append(cascade(features, order, alive))
            for held, more in zip(out, done):
                held.extend(more.tolist())
        return out

    return annotate(docs, text_col, fields, run)
