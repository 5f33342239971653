"""Term-dictionary relevance score, one pass per row and no shuffle.

A dictionary of up to ``INLINE_TERMS`` terms becomes part of the plan, as patterns and
arrays. A larger one is searched by automata in Arrow batches: its size is measured, it is
dealt by hash into portions of at most about ``PORTION_BYTES``, and each portion is broadcast.
The plan grows with the number of portions only. Both ways give the same rows; empty terms
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from jobspectra.functions.lexicon import occurring, sql_text

# --- fixed values: scoring rules ------------------------------------------------------
THRESHOLD = 0.0
TITLE_MULTIPLIER = 3.0
HARD_STOP_SCORE = -999.0
HARD_STOP_REASON = "hard_stop_title"
LOW_SCORE_REASON = "low_score"
# -------------------------------------------------------------------------------------
INLINE_TERMS = 2000
PORTION_BYTES = 16 << 20

_STOP = "struct<ord:bigint,term:string>"
_FOUND = f"struct<soft:double,first:{_STOP},last:{_STOP},body:{_STOP}>"


def active_terms(terms: DataFrame) -> DataFrame:
    return (terms.where("active").where("term <> ''")
            .select(F.coalesce(F.col("ord").cast("long"), F.lit(-1)).alias("ord"), F.lower("term").alias("term"), "kind", "field_scope",
                    F.col("weight").cast("double").alias("weight")))


def score_postings(postings: DataFrame, terms: DataFrame, *, threshold: float = THRESHOLD,
                   title_multiplier: float = TITLE_MULTIPLIER,
                   hard_stop_on_title: bool = True) -> DataFrame:
    """Adds ``relevant``, ``score``, ``reason`` and ``matched_stopword``. No shuffle."""
    active = active_terms(terms)
    few = active.limit(INLINE_TERMS + 1).collect()
    kept = [F.col(c) for c in postings.columns]
    skills = F.concat_ws(" ", F.coalesce("skills", F.array().cast("array<string>")))
    body = F.concat(F.coalesce("description", F.lit("")), F.lit(" "), skills)
    texts = postings.select(*kept, F.lower(F.coalesce("title", F.lit(""))).alias("_title"), F.lower(body).alias("_body"))
    if len(few) <= INLINE_TERMS:
        found = _inline(texts, kept, sorted(few, key=lambda r: (r["ord"], r["term"])), title_multiplier)
    else:
        found = _by_automata(texts, kept, active, title_multiplier)
    stopped = F.col("_first").isNotNull() if hard_stop_on_title else F.lit(False)
    scored = found.select(
        *kept, stopped.alias("_stopped"),
        F.when(stopped, F.lit(HARD_STOP_SCORE)).otherwise(F.col("_soft")).alias("score"),
        F.when(stopped, F.col("_first")).otherwise(F.coalesce("_last", "_in_body")).alias("_stop"))
    relevant = ~F.col("_stopped") & (F.col("score") >= threshold)
    return scored.select(
        *kept, relevant.alias("relevant"), "score",
        F.when(F.col("_stopped"), HARD_STOP_REASON).when(~relevant, LOW_SCORE_REASON).alias("reason"),
        F.when(~relevant, F.col("_stop")).alias("matched_stopword"))


def _signed(kind: str, weight: float) -> float:
    return weight if kind == "positive" else -weight


def _inline(texts: DataFrame, kept: list[Column], rows: list[Row], title_multiplier: float) -> DataFrame:
    """Sums and stop terms from patterns and arrays in the plan."""
    words = [r["term"] for r in rows]
    marked = texts.select(*kept, occurring(F.col("_title"), words, whole_words=False).alias("_title"),
                          occurring(F.col("_body"), words, whole_words=False).alias("_body"))

    def per_term(value) -> Column:
        return F.expr(f"array({', '.join(str(value(r)) for r in rows)})" if rows else "CAST(array() AS array<double>)")

    def weight(row: Row, field: str, factor: float) -> str:
        return f"{_signed(row['kind'], row['weight']) * factor if row['field_scope'] in (field, 'any') else 0.0}D"

    def total(hits: str, field: str, factor: float) -> Column:
        weights = per_term(lambda r: weight(r, field, factor))
        return F.aggregate(hits, F.lit(0.0), lambda acc, i: acc + F.get(weights, i))

    def stops(hits: str, field: str) -> Column:
        flags = per_term(lambda r: "true" if r["kind"] == "stop" and r["field_scope"] in (field, "any") else "false")
        return F.filter(hits, lambda i: F.get(flags, i))

    summed = marked.select(
        *kept, (total("_title", "title", title_multiplier) + total("_body", "description", 1.0)).alias("_soft"),
        stops("_title", "title").alias("_st"), stops("_body", "description").alias("_sb"))
    names = F.expr(f"array({', '.join(sql_text(w) for w in words)})" if words else "CAST(array() AS array<string>)")
    at = lambda c, i: F.get(names, F.get(c, i))
    return summed.select(*kept, "_soft", at("_st", F.lit(0)).alias("_first"), at("_st", F.size("_st") - 1).alias("_last"),
                         at("_sb", F.lit(0)).alias("_in_body"))


def _by_automata(texts: DataFrame, kept: list[Column], active: DataFrame, title_multiplier: float) -> DataFrame:
    """Sums and stop terms from one search per portion of the dictionary."""
    size = active.agg(F.sum(F.octet_length("term") + 32)).first()[0]
    n = -(-size // PORTION_BYTES)
    found = []
    for k in range(n):
        rows = active.where(F.pmod(F.xxhash64("term"), F.lit(n)) == k).collect()
        portion = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])
        found.append(_search(portion, title_multiplier)("_title", "_body").alias(f"_found{k}"))
    each = lambda name: [F.col(f"_found{k}.{name}") for k in range(n)]
    pick = lambda fn, name: (fn(*each(name)) if n > 1 else each(name)[0])["term"]
    return texts.select(*kept, *found).select(
        *kept, sum(each("soft"), F.lit(0.0)).alias("_soft"), pick(F.least, "first").alias("_first"),
        pick(F.greatest, "last").alias("_last"), pick(F.least, "body").alias("_in_body"))


def _search(portion: Broadcast, title_multiplier: float):
    @F.arrow_udf(_FOUND)
    def found(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        by_term: dict[str, list[tuple]] = {}
        for row in portion.value:
            by_term.setdefault(row[1], []).append(row)
        automaton = ahocorasick.Automaton()
        for term, rows in by_term.items():
            automaton.add_word(term, (term, rows))
        if by_term:
            automaton.make_automaton()

        def hits(text: str, field: str) -> list[tuple]:
            terms = {term: rows for _, (term, rows) in automaton.iter(text)} if by_term else {}
            return sorted(row for rows in terms.values() for row in rows if row[3] in (field, "any"))

        def stop(rows: list[tuple], at: int) -> dict | None:
            stops = [row for row in rows if row[2] == "stop"]
            return {"ord": stops[at][0], "term": stops[at][1]} if stops else None

        kind = pa.struct([("ord", pa.int64()), ("term", pa.string())])
        schema = pa.struct([("soft", pa.float64()), ("first", kind), ("last", kind), ("body", kind)])
        for titles, bodies in batches:
            out = []
            for title, body in zip(titles.to_pylist(), bodies.to_pylist()):
                above, below = hits(title, "title"), hits(body, "description")
                soft = sum(_signed(r[2], r[4]) * title_multiplier for r in above) + sum(_signed(r[2], r[4]) for r in below)
                out.append({"soft": float(soft), "first": stop(above, 0), "last": stop(above, -1), "body": stop(below, 0)})
            yield pa.array(out, schema)

    return found
