"""Composite results: dashboard overview, market context, listings and dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobspectra.functions import timebuckets as tb
from jobspectra.functions.skilldict import resolve_alias
from jobspectra.operators import cube as cb
from jobspectra.operators import metrics as m
from jobspectra.operators.metrics import ALL, Slice


# --- fixed values: sizes of the composite results --------------------------------------
OVERVIEW_TOP = 5
CONTEXT_SKILLS = 15
CONTEXT_EMPLOYERS = 10
CONTEXT_PERIODS = 6
RESUME_SKILLS_ALL = 30
RESUME_SKILLS_GRADE = 20
MAX_PAGE_SIZE = 200
# -------------------------------------------------------------------------------------


def last_items(items: Column, n: int) -> Column:
    size = F.size(items)
    return F.when(size > 0, F.slice(items, F.greatest(size - n + 1, F.lit(1)), n)).otherwise(items)


def _headline(postings: DataFrame, where: Slice, slices: Sequence[int], digits: int, n_skills: int, employers: DataFrame | None = None,
              n_employers: int = 0, dimensions: Sequence[str] = ()) -> DataFrame:
    """Everything a composite result needs, one row per slice, from one scan of the fact."""
    kinds = ["days", "amounts", "skills", *["employers"] * (employers is not None), *[d for d in dimensions if d != "grade"]]
    cube = cb.build(where.any_grade().apply(postings), kinds, series=False)
    parts = [cb.skills(cube, slices, n_skills), *[cb.distribution(cube, slices, d) for d in dimensions]]
    if employers is not None:
        months = cb.demand(cube, slices, ["month"])
        parts += [cb.employers(cube, employers, slices, n_employers),
                  cb.ordered(months, ["slice"], [F.col("point")], "months", F.col("point").alias("period"), "count", "growth")]
    return cb.headline(cube, slices, parts, digits)


def _grade_slice(where: Slice) -> list[int]:
    return [m.GRADE_IDS.get(where.grade, cb.ALL_GRADES)]


def _picked(items: str, **names: str) -> Column:
    return F.transform(items, lambda x: F.struct(*[x[c].alias(n) for n, c in names.items()]))


def overview(postings: DataFrame, employers: DataFrame, where: Slice = ALL, digits: int = 2) -> DataFrame:
    """One row with the headline numbers of a slice."""
    row = _headline(postings, where, _grade_slice(where), digits, OVERVIEW_TOP, employers, OVERVIEW_TOP, ["grade"])
    salary = F.col("salary")
    return row.select(
        salary["median"].alias("median"), salary["percentiles"]["p25"].alias("p25"), salary["percentiles"]["p75"].alias("p75"),
        F.col("total").alias("total_vacancies"), salary["disclosure_rate"].alias("disclosure_rate"),
        cb.shared("skills", "skill", "share").alias("top_skills"), _picked("employers", name="name", count="count").alias("top_employers"),
        F.col("grade").alias("grade_distribution"), F.try_element_at("months", F.lit(-1))["growth"].alias("demand_growth"),
        salary["low_confidence"].alias("low_confidence"))


def market_context(postings: DataFrame, employers: DataFrame, where: Slice = ALL, digits: int = 2) -> DataFrame:
    """Anonymous aggregates of a slice: no posting texts and no employer ids."""
    row = _headline(postings, where, _grade_slice(where), digits, CONTEXT_SKILLS, employers, CONTEXT_EMPLOYERS, ["grade", "format"])
    s = F.col("salary")
    salary = F.struct(s["count"].alias("sample_size"), F.col("total").alias("total_vacancies"),
                      *[s[c].alias(c) for c in ("median", "mean", "min", "max", "percentiles", "disclosure_rate")])
    skills = F.transform("skills", lambda x: F.struct(x["skill"].alias("name"), m.share(x["count"], F.col("total")).alias("share"), x["count"].alias("count")))
    return row.select(
        F.lit(where.grade or "all").alias("grade_filter"),
        F.lit(where.date_from).cast("date").alias("date_from"), F.lit(where.date_to).cast("date").alias("date_to"),
        salary.alias("salary"), skills.alias("top_skills"), cb.shared("employers", "name", "count", "share").alias("top_employers"),
        last_items(F.col("months"), CONTEXT_PERIODS).alias("demand_trend"),
        _picked("grade", grade="key", share="share", count="count").alias("grade_distribution"),
        _picked("format", format="key", share="share", count="count").alias("format_distribution"))


def resume_market_context(postings: DataFrame, grade: str | None = None, digits: int = 2) -> DataFrame:
    """Overall salary and skills and, for a known grade, the same of that grade."""
    own = grade not in (None, "all")
    slices = [cb.ALL_GRADES, *_grade_slice(Slice(grade=grade))][:1 + own]
    row = _headline(postings, ALL, slices, digits, max(RESUME_SKILLS_ALL, RESUME_SKILLS_GRADE))
    s = F.col("salary")
    salary = F.struct(s["median"].alias("median"), s["percentiles"]["p25"].alias("p25"), s["percentiles"]["p75"].alias("p75"), s["min"].alias("min"),
                      s["max"].alias("max"), s["count"].alias("sample_size"), F.col("total").alias("total_vacancies"))
    skills = F.transform("skills", lambda x: F.struct(x["skill"].alias("name"), m.share(x["count"], F.col("total")).alias("share"), x["count"].alias("count")))
    columns = [F.lit(grade or "all").alias("grade_filter")]
    for at, name, n in ((slices[0], "all", RESUME_SKILLS_ALL), (slices[-1], "grade", RESUME_SKILLS_GRADE))[:1 + own]:
        here = lambda c, at=at: F.max(F.when(F.col("slice") == at, c))
        columns += [here(salary).alias(f"salary_{name}"), here(F.slice(skills, 1, n)).alias(f"top_skills_{name}")]
    return row.agg(*columns)


def posting_listing(postings: DataFrame, employers: DataFrame, where: Slice = ALL, *,
                    skill: str | None = None, employer_id: int | None = None,
                    page: int = 1, page_size: int = 50) -> DataFrame:
    """One page of postings, newest first, with the total of the filter."""
    if page < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page must be >= 1 and page_size within 1..{MAX_PAGE_SIZE}")
    rows = where.apply(postings)
    if skill is not None:
        rows = rows.where(F.array_contains("skills", skill))
    if employer_id is not None:
        rows = rows.where(F.col("employer_id") == employer_id)
    total = m.total_count(rows)
    chosen = (rows.select("posting_id", "title", "employer_id", "grade_id", "amount_from", "amount_to",
                          "currency", "gross", "estimate", "employment_format", "published_at", "url")
              .orderBy(F.desc("published_at"), "posting_id").offset((page - 1) * page_size).limit(page_size))
    # A page has at most MAX_PAGE_SIZE rows: broadcast, it picks the employers, which are
    # then as few themselves. Neither side is shuffled.
    ids = F.broadcast(chosen.select("employer_id").distinct())
    firms = employers.select("employer_id", F.col("name").alias("employer_name")).join(ids, "employer_id", "left_semi")
    named = chosen.join(F.broadcast(firms), "employer_id", "left")
    return named.select(
        "posting_id", "title", "employer_id", "employer_name",
        m.grade_label(F.col("grade_id"), 1).alias("grade"), "amount_from", "amount_to", "currency", "gross",
        "estimate", "employment_format", "published_at", "url", total.alias("total")
    ).orderBy(F.desc("published_at"), "posting_id")


def skill_dictionary(postings: DataFrame) -> DataFrame:
    return m.skill_rows(postings).groupBy("skill").agg(F.count("*").alias("postings"))


def employer_dictionary(postings: DataFrame, employers: DataFrame) -> DataFrame:
    """Every employer with its number of postings, zero included."""
    counts = postings.groupBy("employer_id").agg(F.count("*").alias("postings"))
    return (employers.select("employer_id", "name").join(counts, "employer_id", "left")
            .select("employer_id", "name", F.coalesce("postings", F.lit(0)).alias("postings")))


def resolve_aliases(postings: DataFrame) -> DataFrame:
    """Skill arrays with aliases replaced by their canonical names, duplicates merged."""
    return postings.withColumn("skills", F.array_distinct(F.transform("skills", lambda s: resolve_alias(s))))


def latest_day(postings: DataFrame) -> Column:
    return postings.agg(tb.local_date(F.max("published_at")).alias("d")).scalar()


_CSV = {"header": True, "nullValue": "", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str) -> None:
    """Tabular export with a header, one part file per partition. Quotes are doubled, so that
    texts with quotes, separators, line breaks or outer spaces come back; an empty text is written as a null."""
    df.write.mode("overwrite").options(**_CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """An export read back. A part file with texts of several lines is read by one task."""
    return spark.read.schema(schema).options(**_CSV, multiLine=True, mode="FAILFAST").csv(path)


