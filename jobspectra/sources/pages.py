"""Landed HTML pages to raw postings, search links and counters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobspectra.functions import fields, html, salary
from jobspectra.functions.html import PageReader, Rule

# --- fixed values: default markup of a posting page and of a search page ---------------
POSTING_RULES = [
    Rule("title", "h1", "data-qa", "vacancy-title"),
    Rule("salary", None, "data-qa", "vacancy-salary"),
    Rule("employer_name", "a", "data-qa", "vacancy-company-name"),
    Rule("employer_url", "a", "data-qa", "vacancy-company-name", take="attr:href"),
    Rule("experience", None, "data-qa", "vacancy-experience"),
    Rule("work_format", None, "data-qa", "work-formats-text"),
    Rule("description", "div", "data-qa", "vacancy-description"),
    Rule("skill", "li", "data-qa", "skills-element"),
    Rule("skill_tag", "div", "class", "tag__label", contains=True, inside="skill"),
    Rule("published", "p", "class", "vacancy-creation-time-redesigned"),
    Rule("published_alt", "span", "data-qa", "vacancy-creation-time"),
]
PUBLISHED_PHRASE = "Вакансия опубликована"
SEARCH_LINK = r"""\bclass\s*=\s*["'][^"'>]*\bserp-item__title\b"""
SEARCH_LINK_ALT = r"""\bdata-qa\s*=\s*["']serp-item__title["']"""
COUNTER = r"""\bdata-qa\s*=\s*["']title["']"""
COUNTER_BOX = r"""(?is)\bdata-qa\s*=\s*["']vacancies-search-header["'][^>]*>.*?(<h1\b.*?</h1\s*>)"""
# -------------------------------------------------------------------------------------

_TEXTS = ["title", "salary", "employer_name", "employer_url", "experience", "work_format",
          "description"]
_SCHEMA = ", ".join([f"{name} string" for name in _TEXTS]
                    + ["skill array<string>", "published array<string>"])


def split_blocked(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable pages, blocked pages)."""
    return pages.where(~html.is_blocked(F.col("html"))), pages.where(html.is_blocked(F.col("html")))


def page_texts(pages: DataFrame, rules: list[Rule] = POSTING_RULES,
               phrase: str | None = PUBLISHED_PHRASE, keep_html: bool = False) -> DataFrame:
    """Text of every configured element; first hit for single fields, all for lists.

    Nested markup needs a tree, so this one step runs in Python over Arrow batches; all
    typing and parsing of the texts happens in native columns afterwards.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, url, markup in zip(batch["page_id"], batch["url"], batch["html"]):
                reader = PageReader(rules, phrase)
                reader.feed(markup or "")
                found = reader.finish()
                first = [(found.get(name) or [None])[0] for name in _TEXTS]
                skills = reader.innermost("skill") if "skill" in found else []
                dates = (found.get("published", [])[:1] + found.get("published_alt", [])[:1]
                         + reader.prefixed)
                rows.append([page_id, url, *first, [s for s in skills if s], dates, *[markup] * keep_html])
            yield pd.DataFrame(rows, columns=["page_id", "url", *_TEXTS, "skill", "published", *["html"] * keep_html])

    return pages.select("page_id", "url", "html").mapInPandas(
        read, schema=f"page_id long, url string, {_SCHEMA}" + ", html string" * keep_html)


def raw_postings(pages: DataFrame, current_year: Column | int,
                 rules: list[Rule] = POSTING_RULES, id_segment: str = "vacancy",
                 keep_html: bool = True, extra: Sequence[str] = ()) -> DataFrame:
    """Raw posting rows; a page without a title yields no row. The markup comes along
    unless ``keep_html`` is off, and ``extra`` names columns of ``page_texts`` to keep."""
    year = F.lit(current_year) if isinstance(current_year, int) else current_year
    texts = page_texts(pages, rules, keep_html=keep_html).where("title is not null and title <> ''")
    pay = salary.salary_from_text(F.col("salary"))
    dates = F.filter(F.transform("published", lambda d: fields.russian_date(d, year)),
                     lambda d: d.isNotNull())
    rows = texts.select(
        F.coalesce(fields.id_after(F.col("url"), id_segment), F.col("page_id")).alias("posting_id"),
        "title", "url", "employer_name",
        fields.id_after(F.col("employer_url"), "employer").alias("employer_id"), "employer_url",
        pay["amount_from"].alias("salary_from"), pay["amount_to"].alias("salary_to"),
        pay["currency"].alias("salary_currency"), pay["gross"].alias("salary_gross"),
        F.col("experience").alias("experience_raw"),
        fields.work_format(F.coalesce("work_format", F.lit(""))).alias("employment_format"),
        F.lit(None).cast("string").alias("area_name"),
        F.get(dates, F.lit(0)).alias("published_at"), "description",
        F.col("skill").alias("skills"), F.lit("html").alias("source_type"),
        F.lit(None).cast("string").alias("raw_payload"),
        (F.col("html") if keep_html else F.lit(None).cast("string")).alias("raw_html"), *extra)
    return rows


def search_links(pages: DataFrame, base_url: str, marker: str = SEARCH_LINK,
                 marker_alt: str = SEARCH_LINK_ALT, id_segment: str = "vacancy") -> DataFrame:
    """(page_id, position, posting_id, url): first link per id within each page."""
    primary, other = html.links(F.col("html"), marker), html.links(F.col("html"), marker_alt)
    found = F.when(F.size(primary) > 0, primary).otherwise(other)
    located = F.transform(found, lambda href, i: F.struct(
        fields.id_after(href, id_segment).alias("posting_id"), i.alias("position"),
        F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base_url), href)).alias("url")))
    valid = F.filter(located, lambda x: x["posting_id"].isNotNull())
    listed = pages.select("page_id", valid.alias("l")).select(
        "page_id", "l", F.transform("l", lambda x: x["posting_id"]).alias("ids"))
    # A page is one row, so repeats are dropped inside its array; nothing is shuffled.
    first = F.filter("l", lambda x, i: F.array_position("ids", x["posting_id"]) == i + 1)
    return (listed.select("page_id", F.explode(first).alias("x"))
            .select("page_id", "x.position", "x.posting_id", "x.url"))


def result_counts(pages: DataFrame) -> DataFrame:
    """(page_id, results): the counter of each search page."""
    main = html.tag_text(F.col("html"), "h1", COUNTER)
    boxed = html.tag_text(F.regexp_extract("html", COUNTER_BOX, 1), "h1")
    return pages.select("page_id", html.counter_value(F.coalesce(main, boxed)).alias("results"))
