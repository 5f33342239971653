"""The metric catalogue over the posting fact.

Postings carry salary columns and a ``skills`` array. Every function takes a ``Slice``
(local day range and grade) whose predicates reach the scan, and returns a DataFrame.
Money is rounded to ``digits`` decimals (two for display).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobspectra.functions import timebuckets as tb
from jobspectra.operators.pairs import top_pairs
from jobspectra.operators.quantiles import exact_percentiles, merge_by_group, percentiles, value_counts
from jobspectra.schema import (
    CONCENTRATION_TOP, GRADE_IDS, GRADES, LOW_CONFIDENCE_BELOW, MAX_TOP_N, PERCENTILES, TOP_N)


@dataclass(frozen=True)
class Slice:
    """Inclusive local days and one grade; ``None`` or ``"all"`` means no restriction."""

    date_from: dt.date | None = None
    date_to: dt.date | None = None
    grade: str | None = None

    def __post_init__(self) -> None:
        if self.grade not in (None, "all", *GRADE_IDS):
            raise ValueError(f"unknown grade {self.grade!r}")

    def apply(self, postings: DataFrame) -> DataFrame:
        kept = postings
        if self.date_from or self.date_to:
            kept = kept.where(tb.in_date_range(F.col("published_at"), self.date_from, self.date_to))
        if self.grade not in (None, "all"):
            kept = kept.where(F.col("grade_id") == GRADE_IDS[self.grade])
        return kept

    def any_grade(self) -> "Slice":
        return replace(self, grade=None)


ALL = Slice()


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part.cast("double") / whole, 4))


def low_confidence(sample: Column) -> Column:
    return F.coalesce(sample < LOW_CONFIDENCE_BELOW, F.lit(True))


def _limit(n: int) -> int:
    if not 1 <= n <= MAX_TOP_N:
        raise ValueError(f"limit must be within 1..{MAX_TOP_N}")
    return n


def _mean(total: Column, n: Column, digits: int) -> Column:
    return F.when(n > 0, F.round(total.cast("double") / n, digits))


def total_count(rows: DataFrame) -> Column:
    """Row count as a scalar subquery."""
    return rows.agg(F.count("*").alias("n")).scalar()


# --- salaries -------------------------------------------------------------------------

def salary_summary(postings: DataFrame, where: Slice = ALL, by: Sequence[str] = (), *,
                   digits: int = 2, mean_digits: int | None = None) -> DataFrame:
    """Counts, spread, mean, percentiles, mean bounds and disclosure, per ``by`` group."""
    mean_digits = digits if mean_digits is None else mean_digits
    rows = where.apply(postings)
    has = F.col("estimate").isNotNull()
    bound = lambda c: F.when(has, F.col(c))
    base = rows.groupBy(*by).agg(
        F.count("estimate").alias("count"), F.count("*").alias("total_count"),
        F.min("estimate").alias("min"), F.max("estimate").alias("max"),
        F.sum("estimate").alias("_sum"),
        F.sum(bound("from_net")).alias("_from"), F.count(bound("from_net")).alias("_n_from"),
        F.sum(bound("to_net")).alias("_to"), F.count(bound("to_net")).alias("_n_to"))
    ranks = exact_percentiles(rows, by, "estimate", PERCENTILES)
    both = merge_by_group([base, ranks], by)
    c = F.col
    return both.select(
        *by, "count", "total_count",
        F.round(c("p50"), digits).alias("median"),
        c("min").cast("double").alias("min"), c("max").cast("double").alias("max"),
        _mean(c("_sum"), c("count"), mean_digits).alias("mean"),
        *[F.round(f"p{p}", digits).alias(f"p{p}") for p in PERCENTILES],
        _mean(c("_from"), c("_n_from"), mean_digits).alias("range_from"),
        _mean(c("_to"), c("_n_to"), mean_digits).alias("range_to"),
        share(c("count"), c("total_count")).alias("disclosure_rate"),
        low_confidence(c("count")).alias("low_confidence"))


def _bucketed(postings: DataFrame, where: Slice, period: str) -> DataFrame:
    rows = where.apply(postings).where(F.col("published_at").isNotNull())
    day = tb.local_date(F.col("published_at"))
    return rows.withColumn("period_start", tb.period_start(day, period))


def salary_series(postings: DataFrame, period: str = "month", where: Slice = ALL, *,
                  digits: int = 2) -> DataFrame:
    """Median and quartiles per bucket; buckets without a salary are absent."""
    rows = _bucketed(postings, where, period)
    values = value_counts(rows, ["period_start"], "estimate")
    counts = values.groupBy("period_start").agg(F.sum("_count").alias("count"))
    ranks = percentiles(values, ["period_start"], (50, 25, 75), ("median", "p25", "p75"))
    merged = merge_by_group([counts, ranks], ["period_start"])
    return merged.select("period_start",
                         *[F.round(c, digits).alias(c) for c in ("median", "p25", "p75")],
                         "count").orderBy("period_start")


# --- demand ---------------------------------------------------------------------------

def growth(count: Column, previous: Column) -> Column:
    return F.when(previous > 0, F.round((count - previous).cast("double") / previous, 4))


def demand_series(postings: DataFrame, period: str = "month", where: Slice = ALL, *,
                  fill_gaps: bool = False) -> DataFrame:
    """Postings per bucket and change against the previous non-empty bucket.

    ``fill_gaps`` adds empty buckets from the calendar. The window has no partition key,
    but it runs over one row per bucket.
    """
    counts = _bucketed(postings, where, period).groupBy("period_start").agg(F.count("*").alias("count"))
    if fill_gaps:
        counts = _with_empty_buckets(counts, period)
    order = Window.orderBy("period_start")
    return (counts.select("period_start", "count",
                          growth(F.col("count"), F.lag("count").over(order)).alias("growth"))
            .orderBy("period_start"))


def _with_empty_buckets(counts: DataFrame, period: str) -> DataFrame:
    ends = counts.agg(F.min("period_start").alias("a"), F.max("period_start").alias("b"))
    spine = (ends.where("a is not null")
             .select(F.explode(tb.period_sequence(F.col("a"), F.col("b"), period)).alias("period_start"),
                     F.lit(0).cast("long").alias("count")))
    return counts.unionByName(spine).groupBy("period_start").agg(F.sum("count").alias("count"))


def demand_moving_average(postings: DataFrame, period: str = "day", points: int = 7,
                          where: Slice = ALL) -> DataFrame:
    """Trailing mean over ``points`` buckets of the gap-free series."""
    series = demand_series(postings, period, where, fill_gaps=True)
    trailing = Window.orderBy("period_start").rowsBetween(-(points - 1), 0)
    total, n = F.sum("count").over(trailing), F.count("*").over(trailing)
    return series.select("period_start", "count",
                         F.round(total.cast("double") / n, 4).alias("moving_average"))


# --- skills ---------------------------------------------------------------------------

def skill_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per posting and skill; the array holds each skill once."""
    return rows.select(*keep, F.explode("skills").alias("skill"))


def top_skills(postings: DataFrame, where: Slice = ALL, n: int = TOP_N) -> DataFrame:
    """Most wanted skills; shares are of all postings in the slice."""
    rows = where.apply(postings)
    counts = skill_rows(rows).groupBy("skill").agg(F.count("*").alias("count"))
    best = counts.orderBy(F.desc("count"), "skill").limit(_limit(n))
    total = total_count(rows)
    return best.select("skill", "count", share(F.col("count"), total).alias("share"),
                       total.alias("sample_size"), low_confidence(total).alias("low_confidence"))


def top_skills_by(postings: DataFrame, by: str, where: Slice = ALL, n: int = TOP_N) -> DataFrame:
    """A separate ranking per value of ``by`` (for example ``grade_id``)."""
    rows = where.apply(postings)
    counts = skill_rows(rows, by).groupBy(by, "skill").agg(F.count("*").alias("count"))
    order = Window.partitionBy(by).orderBy(F.desc("count"), "skill")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= _limit(n))
    totals = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("sample_size"))
    joined = best.join(totals, F.col(by).eqNullSafe(F.col("_by")))
    return joined.select(by, "rank", "skill", "count",
                         share(F.col("count"), F.col("sample_size")).alias("share"), "sample_size",
                         low_confidence(F.col("sample_size")).alias("low_confidence"))


def skill_changes(postings: DataFrame, period: str = "month", where: Slice = ALL) -> DataFrame:
    """Buckets in which the count of a skill may differ from the bucket before: those with
    a sighting, and the empty one right after each run of sightings.

    ``covers_from`` and ``covers_to`` (exclusive) say for which buckets a row speaks: between
    its own and ``covers_to`` the skill is absent, and before its first sighting from
    ``covers_from`` on. At most two rows per skill and bucket with a sighting, none of them
    made before the shuffle; a skill's window holds at most one row per bucket.
    """
    rows = _bucketed(postings, where, period)
    totals = rows.groupBy("period_start").agg(F.count("*").alias("total"))
    seen = (skill_rows(rows, "period_start").groupBy("skill", "period_start")
            .agg(F.count("*").alias("count")))
    # One row per bucket of the calendar.
    shared = (seen.join(F.broadcast(totals), "period_start")
              .select("skill", "period_start", "count", share(F.col("count"), F.col("total")).alias("share")))
    ends = totals.agg(F.min("period_start").alias("a"), F.max("period_start").alias("b"))
    order = Window.partitionBy("skill").orderBy("period_start")
    here = F.col("period_start")
    after = lambda day: tb.period_end(day, period)
    marked = shared.select(
        "*", F.lag(F.struct("period_start", "count", "share")).over(order).alias("_before"), F.lead(here).over(order).alias("_next"),
        ends.select("a").scalar().alias("_a"), after(ends.select("b").scalar()).alias("_end"))
    adjacent = after(F.col("_before.period_start")) == here
    old = lambda c: F.when(adjacent, F.col(f"_before.{c}")).when(here > F.col("_a"), F.lit(0))
    row = lambda start, count, part, d_count, d_share, lo, hi: F.struct(
        start.alias("period_start"), count.cast("long").alias("count"), part.cast("double").alias("share"),
        d_count.cast("long").alias("count_delta"), F.round(d_share, 4).alias("share_delta"), lo.alias("covers_from"), hi.alias("covers_to"))
    until = F.coalesce("_next", "_end")
    first = F.when(F.col("_before").isNull(), F.col("_a")).otherwise(here)
    own = row(here, F.col("count"), F.col("share"), F.col("count") - old("count"), F.col("share") - old("share"), first, after(here))
    gone = row(after(here), F.lit(0), F.lit(0.0), -F.col("count"), -F.col("share"), after(here), until)
    both = F.when(after(here) < until, F.array(own, gone)).otherwise(F.array(own))
    return marked.select("skill", F.explode(both).alias("r")).select("skill", "r.*")


def skill_delta(postings: DataFrame, period: str = "month", where: Slice = ALL) -> DataFrame:
    """Count and share of each skill per bucket, and their change from the bucket before.

    Buckets run from the first to the last one with any posting; a bucket in which a
    skill is absent counts as zero, so a disappearing skill shows its fall. The rows
    without a change are spread out from ``skill_changes`` where they are read, with no shuffle.
    """
    changes = skill_changes(postings, period, where)
    days = F.filter(tb.period_sequence(F.col("covers_from"), F.col("covers_to"), period), lambda d: d < F.col("covers_to"))
    spread = changes.withColumn("_day", F.explode(days))
    own = F.col("_day") == F.col("period_start")
    value = lambda c, other: F.when(own, F.col(c)).otherwise(other).alias(c)
    # Before its first sighting a skill is covered from the first bucket of all on, which has none before it.
    unchanged = lambda zero: F.when(F.col("_day") > F.col("covers_from"), zero)
    return spread.select(
        "skill", F.col("_day").alias("period_start"), value("count", F.lit(0).cast("long")), value("share", F.lit(0.0)),
        value("count_delta", unchanged(F.lit(0).cast("long"))), value("share_delta", unchanged(F.lit(0.0))))


def skill_pairs(postings: DataFrame, where: Slice = ALL, n: int = TOP_N,
                by: Sequence[str] = ()) -> DataFrame:
    """Top unordered skill pairs (a < b) within postings, exactly, per ``by`` group (see ``pairs``)."""
    by = list(by)
    rows = where.apply(postings)
    best = top_pairs(rows.select(*by, F.col("skills").alias("items"), F.lit(1).cast("long").alias("weight")), _limit(n), by)
    if by:
        totals = rows.groupBy(*by).agg(F.count("*").alias("sample_size"))
        best, total = best.join(totals, by), F.col("sample_size")
    else:
        total = total_count(rows)
    return best.select(*by, "rank", "a", "b", "count", share(F.col("count"), total).alias("share"),
                       total.alias("sample_size"), low_confidence(total).alias("low_confidence"))


# --- employers ------------------------------------------------------------------------

def top_employers(postings: DataFrame, employers: DataFrame, where: Slice = ALL, n: int = TOP_N,
                  *, exact_concentration: bool = False) -> DataFrame:
    """Employers by postings. Rows without a known employer count in the denominator only.

    ``top10_concentration`` sums the first ten of the returned list; with
    ``exact_concentration`` the ten largest even when ``n`` is smaller.
    """
    rows = where.apply(postings)
    counts = (rows.where(F.col("employer_id").isNotNull()).groupBy("employer_id")
              .agg(F.count("*").alias("count")))
    named = counts.join(employers.select("employer_id", "name"), "employer_id")
    wanted = max(_limit(n), CONCENTRATION_TOP) if exact_concentration else _limit(n)
    best = named.orderBy(F.desc("count"), "employer_id").limit(wanted)
    order = Window.orderBy(F.desc("count"), "employer_id")
    ranked = best.withColumn("rank", F.row_number().over(order))
    head = F.sum(F.when(F.col("rank") <= CONCENTRATION_TOP, F.col("count"))).over(Window.partitionBy())
    total = total_count(rows)
    listed = ranked.select("rank", "employer_id", "name", "count",
                           share(F.col("count"), total).alias("share"),
                           share(head, total).alias("top10_concentration"),
                           total.alias("sample_size"), low_confidence(total).alias("low_confidence"))
    return listed.where(F.col("rank") <= n)


# --- distributions --------------------------------------------------------------------


def grade_label(grade_id: Column, field: int) -> Column:
    """Code (1) or title (2) of a grade id; NULL or unknown ids give ``unknown``."""
    chain = None
    for row in GRADES:
        hit = grade_id == row[0]
        chain = F.when(hit, row[field]) if chain is None else chain.when(hit, row[field])
    return F.coalesce(chain, F.lit(GRADES[-1][field]))


DIMENSIONS = ("grade", "format", "experience")


def dimension_key(by: str) -> Column:
    if by == "grade":
        return grade_label(F.col("grade_id"), 1)
    column = {"format": "employment_format", "experience": "experience_raw"}[by]
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))


def distribution(postings: DataFrame, by: str, where: Slice = ALL) -> DataFrame:
    """Share of each grade, work format or experience level.

    The grade view ignores the grade filter. Postings without a value and those of the
    grade ``unknown`` form one row.
    """
    if by not in DIMENSIONS:
        raise ValueError(f"by must be one of {DIMENSIONS}")
    rows = (where.any_grade() if by == "grade" else where).apply(postings)
    counts = rows.groupBy(dimension_key(by).alias("key")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("n")).scalar()
    label = (F.initcap("key") if by == "grade"
             else F.when(F.col("key") == "unknown", F.lit("Unknown")).otherwise(F.col("key")))
    return (counts.select("key", label.alias("label"), "count",
                          share(F.col("count"), total).alias("share"), total.alias("sample_size"),
                          low_confidence(total).alias("low_confidence"))
            .orderBy(F.desc("count"), "key"))


def date_span(postings: DataFrame) -> DataFrame:
    """First and last local publication day."""
    ends = postings.agg(F.min("published_at").alias("a"), F.max("published_at").alias("b"))
    return ends.select(tb.local_date(F.col("a")).alias("first_day"),
                       tb.local_date(F.col("b")).alias("last_day"))
