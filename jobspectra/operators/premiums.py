"""Pay premiums, histograms, outlier trimming and currency views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobspectra.functions import salary as pay
from jobspectra.functions import timebuckets as tb
from jobspectra.operators.metrics import ALL, Slice, salary_series, salary_summary, skill_rows
from jobspectra.operators.quantiles import (
    BOUNDED_GROUPS, bin_counts, choose_bins, exact_percentiles, interpolated, merge_by_group,
    percentiles, value_counts, with_bin)
from jobspectra.schema import GRADE_IDS, PERCENTILES
from jobspectra.session import scratch


def salary_histogram(postings: DataFrame, width: int, where: Slice = ALL) -> DataFrame:
    """Postings per estimate bin [bin_start, bin_start + width)."""
    rows = where.apply(postings).where(F.col("estimate").isNotNull())
    start = F.floor(F.col("estimate") / F.lit(width)).cast("long") * width
    return (rows.groupBy(start.alias("bin_start")).agg(F.count("*").alias("count"))
            .select("bin_start", (F.col("bin_start") + width).alias("bin_end"), "count")
            .orderBy("bin_start"))


def trimmed_extremes(postings: DataFrame, by: str, method: str = "percentile",
                     where: Slice = ALL) -> DataFrame:
    """Smallest and largest estimate inside [p1, p99] or the 1.5 IQR fences, per group."""
    counts = value_counts(where.apply(postings), [by], "estimate")
    if method == "percentile":
        ranks = percentiles(counts, [by], (1, 99), ("low", "high"))
    elif method == "iqr":
        quartiles = percentiles(counts, [by], (25, 75), ("q1", "q3"))
        ranks = quartiles.selectExpr(by, "q1 - (q3 - q1) * 1.5D AS low", "q3 + (q3 - q1) * 1.5D AS high")
    else:
        raise ValueError("method must be 'percentile' or 'iqr'")
    fences = ranks.select(F.col(by).alias("_by"), "low", "high")
    if by in BOUNDED_GROUPS:
        fences = F.broadcast(fences)
    amount = F.col("_cents").cast("double") / 100
    inside = amount.between(F.col("low"), F.col("high"))
    joined = counts.join(fences, F.col(by).eqNullSafe(F.col("_by")))
    return joined.groupBy(by).agg(
        F.min(amount).alias("raw_min"), F.max(amount).alias("raw_max"), F.sum("_count").alias("count"),
        F.min(F.when(inside, amount)).alias("trimmed_min"), F.max(F.when(inside, amount)).alias("trimmed_max"),
        F.sum(F.when(inside, F.col("_count")).otherwise(0)).alias("kept_count"))


def _medians(postings: DataFrame, key: Column, wanted: Sequence, where: Slice) -> DataFrame:
    """Medians of the wanted key values side by side as ``m0``, ``m1``, ..."""
    rows = where.apply(postings).withColumn("_key", key).where(F.col("_key").isin(*wanted))
    medians = exact_percentiles(rows, ["_key"], "estimate", (50,), ("median",))
    return medians.agg(*[F.max(F.when(F.col("_key") == k, F.col("median"))).alias(f"m{i}")
                         for i, k in enumerate(wanted)])


def grade_premium(postings: DataFrame, upper: str = "senior", lower: str = "junior",
                  where: Slice = ALL) -> DataFrame:
    """Ratio of the median estimates of two grades."""
    pair = _medians(postings, F.col("grade_id"), (GRADE_IDS[upper], GRADE_IDS[lower]), where.any_grade())
    return pair.select(F.col("m0").alias("upper_median"), F.col("m1").alias("lower_median"),
                       F.when(F.col("m1") > 0, F.round(F.col("m0") / F.col("m1"), 4)).alias("premium"))


def remote_premium(postings: DataFrame, where: Slice = ALL) -> DataFrame:
    """Difference between the median remote and the median office estimate."""
    pair = _medians(postings, F.col("employment_format"), ("remote", "office"), where)
    return pair.select(F.col("m0").alias("remote_median"), F.col("m1").alias("office_median"),
                       F.round(F.col("m0") - F.col("m1"), 4).alias("premium"))


def skill_premium(postings: DataFrame, where: Slice = ALL, n: int | None = None) -> DataFrame:
    """Median estimate with a skill minus the median without it, for all skills or the top ``n``.

    "Without" is never formed row by row: per skill it is the counts of all postings
    minus those of the postings with the skill. Taking away k postings moves the median
    by at most k ranks, so only the coarse bins in that reach are set against the skill's
    own; the bins below and above are summed up. Inside the one or two bins of the median
    only the skill's own values are looked at (see ``_values_without``). The postings are
    read once; their amounts and the counts by skill lie in the shared folder.
    """
    rows = scratch(where.apply(postings).where("estimate IS NOT NULL").select("estimate", "skills"), "paid")
    having = scratch(value_counts(skill_rows(rows, "estimate"), ["skill"], "estimate"), "having")
    everyone = value_counts(rows, [], "estimate")
    best = having.groupBy("skill").agg(F.sum("_count").alias("sample_size"))
    if n is not None:
        best = best.orderBy(F.desc("sample_size"), "skill").limit(n)
        having = having.join(best.select("skill"), "skill", "left_semi")

    # Bins of all postings with the number of postings up to each: one short array.
    upto = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = bin_counts(everyone, []).select("_bin", "_count", F.sum("_count").over(upto).alias("_upto"))
    every = summed.agg(F.array_sort(F.collect_list(F.struct("_bin", "_count", "_upto"))).alias("b")).scalar()
    known = best.select("skill", "sample_size", every.alias("_every"))
    known = known.select("*", F.col("_every")[F.size("_every") - 1]["_upto"].alias("_all")) \
        .withColumn("_rest", F.col("_all") - F.col("sample_size")).where("_rest > 0")
    low, high = F.expr("(_rest - 1) div 2 + 1"), F.expr("_rest div 2 + sample_size")
    reach = known.select("skill", "_all", F.filter("_every", lambda x: (x["_upto"] >= low) & (
        x["_upto"] - x["_count"] <= high)).alias("_near"))
    reach = reach.select("skill", "_near", F.col("_near")[0].alias("_a"), F.col("_near")[F.size("_near") - 1].alias("_z"), "_all")
    ends = F.array(F.struct((F.col("_a._bin") - 1).alias("_bin"), (F.col("_a._upto") - F.col("_a._count")).alias("_count")),
                   F.struct((F.col("_z._bin") + 1).alias("_bin"), (F.col("_all") - F.col("_z._upto")).alias("_count")))
    inside = F.transform("_near", lambda x: F.struct(x["_bin"].alias("_bin"), x["_count"].alias("_count")))
    left = reach.select("skill", F.explode(F.concat(ends, inside)).alias("x")).select("skill", "x._bin", "x._count")
    limits = reach.select("skill", (F.col("_a._bin") - 1).alias("_low"), (F.col("_z._bin") + 1).alias("_high"))
    own = bin_counts(having, ["skill"]).join(limits, "skill").select(
        "skill", F.greatest("_low", F.least("_high", "_bin")).alias("_bin"), "_count")
    chosen = choose_bins(_minus(left, own, ["skill", "_bin"]), ["skill"], (50,))
    without = interpolated(_values_without(everyone, having, chosen), ["skill"], (50,), ["median_without"])
    having_medians = percentiles(having, ["skill"], (50,), ["median_with"])
    merged = merge_by_group([best, having_medians, without], ["skill"])
    return merged.select("skill", "sample_size", "median_with", "median_without",
                         F.round(F.col("median_with") - F.col("median_without"), 4).alias("premium"))


def _values_without(everyone: DataFrame, having: DataFrame, chosen: DataFrame) -> DataFrame:
    """Values at the chosen ranks among the postings without a skill, per skill.

    Below a skill's own value lie as many others as postings up to it less own ones up to
    it. Own values with at most ``at`` others up to them lie below the wanted value, which
    is thus the one at that rank plus their number among all postings of the bin. So a bin
    is set against the skills' own values only and never repeated for each skill.
    """
    so_far = lambda *keys: Window.partitionBy(*keys).orderBy("_cents").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = with_bin(everyone).select("_bin", "_cents", "_count", F.sum("_count").over(so_far("_bin")).alias("_upto"))
    ranks = chosen.where("_k_skill IS NOT NULL").select(
        F.col("_k_skill").alias("skill"), F.col("_k_bin").alias("_bin"), "_total", F.explode("_ranks").alias("r"))
    ranks = ranks.select("skill", "_bin", "_total", F.col("r.key").alias("_key_at"), F.col("r.at").alias("_at"))
    own = with_bin(having).join(ranks.select("skill", "_bin").distinct(), ["skill", "_bin"], "left_semi")
    own = own.join(placed.select("_bin", "_cents", "_upto"), ["_bin", "_cents"]).select(
        "skill", "_bin", "_count", (F.col("_upto") - F.sum("_count").over(so_far("skill", "_bin"))).alias("_others"))
    below = F.sum(F.when(F.col("_others") <= F.col("_at"), F.col("_count")).otherwise(0))
    sought = ranks.join(own, ["skill", "_bin"], "left").groupBy("skill", "_bin", "_total", "_key_at", "_at").agg(below.alias("_below"))
    sought = sought.select("skill", "_bin", "_total", "_key_at", (F.col("_at") + F.col("_below")).alias("_place"), F.lit(True).alias("_sought"))
    line = placed.select("_bin", "_cents", (F.col("_upto") - F.col("_count")).alias("_place"), F.lit(False).alias("_sought")) \
        .unionByName(sought, allowMissingColumns=True)
    before = Window.partitionBy("_bin").orderBy("_place", "_sought").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = line.withColumn("_cents", F.last("_cents", True).over(before)).where("_sought")
    return found.select("skill", "_cents", "_total", "_key_at")


def _minus(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of ``left`` less those of ``right``, keys without a remainder left out."""
    negative = right.select(*keys, (-F.col("_count")).alias("_count"))
    summed = left.select(*keys, "_count").unionByName(negative).groupBy(*keys).agg(F.sum("_count").alias("_count"))
    return summed.where("_count > 0")


def _code(currency: str) -> str:
    if not currency.isalpha():
        raise ValueError(f"not a currency code: {currency!r}")
    return currency.upper()


def salary_in_currency(postings: DataFrame, currency: str = "RUB", basis: str = "net",
                       where: Slice = ALL) -> DataFrame:
    """Estimate percentiles shown in another currency and tax basis.

    Both conversions are one positive factor, so the percentiles are taken once in the
    stored base and scaled.
    """
    rows = where.apply(postings)
    ranks = exact_percentiles(rows, [], "estimate", (25, 50, 75))
    rate = F.expr(pay.rate_to_base(f"'{_code(currency)}'"))
    return ranks.select(F.lit(_code(currency)).alias("currency"), F.lit(basis).alias("basis"),
                        *[pay.convert_estimate(F.col(f"p{p}"), rate, basis).alias(f"p{p}") for p in (25, 50, 75)])


_MONEY = ("median", "min", "max", "mean", *(f"p{p}" for p in PERCENTILES), "range_from", "range_to")


def _shown(stats: DataFrame, currency: str, basis: str) -> DataFrame:
    """Money columns in another currency and basis, which are added in front; counts stay."""
    code = _code(currency)
    rate = F.expr(pay.rate_to_base(f"'{code}'"))
    return stats.select(F.lit(code).alias("currency"), F.lit(basis).alias("basis"), *[
        pay.convert_estimate(F.col(c), rate, basis).alias(c) if c in _MONEY else F.col(c) for c in stats.columns])


def salary_summary_in_currency(postings: DataFrame, currency: str = "RUB", basis: str = "net", where: Slice = ALL,
                               by: Sequence[str] = ()) -> DataFrame:
    """The full summary shown in another currency and tax basis. Both are one positive factor,
    so means and percentiles are taken in the stored base and scaled."""
    return _shown(salary_summary(postings, where, by, digits=4, mean_digits=6), currency, basis)


def salary_series_in_currency(postings: DataFrame, period: str = "month", currency: str = "RUB", basis: str = "net",
                              where: Slice = ALL) -> DataFrame:
    """Median and quartiles per bucket shown in another currency and tax basis, in order."""
    return _shown(salary_series(postings, period, where, digits=4), currency, basis).orderBy("period_start")


# --- dated exchange rates -------------------------------------------------------------

def rate_calendar(rates: DataFrame, days: DataFrame) -> DataFrame:
    """(currency, day, rate, distance): the nearest known rate for every day of a span.

    ``rates`` is (currency, rate_date, rate); ``days`` has one row (first_day, last_day).
    The earlier rate wins a tie. The result has one row per currency and day, so the
    as-of join against the fact becomes a plain equality join with a small table.
    """
    span = days.select(F.sequence("first_day", "last_day", F.expr("INTERVAL '1' DAY"))).scalar()
    grid = rates.select("currency").distinct().select("currency", F.explode(span).alias("day"),
                                                      F.lit(None).cast("date").alias("rate_date"),
                                                      F.lit(None).cast("decimal(14,6)").alias("rate"))
    known = rates.select("currency", F.col("rate_date").alias("day"), "rate_date",
                         F.col("rate").cast("decimal(14,6)").alias("rate"))
    point = F.struct("rate_date", "rate")
    marked = known.unionByName(grid).withColumn("_known", F.when(F.col("rate").isNotNull(), point))
    order = Window.partitionBy("currency").orderBy("day")
    before = F.last("_known", True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("_known", True).over(order.rangeBetween(0, Window.unboundedFollowing))
    sided = marked.select("currency", "day", "rate_date", before.alias("b"), after.alias("a"))
    back, ahead = F.datediff("day", "b.rate_date"), F.datediff("a.rate_date", "day")
    later = F.col("b").isNull() | (ahead < back)
    return (sided.where("rate_date is null")
            .select("currency", "day", F.when(later, F.col("a.rate")).otherwise(F.col("b.rate")).alias("rate"),
                    F.when(later, ahead).otherwise(back).alias("distance_days")))


def convert_at_publication(postings: DataFrame, rates: DataFrame, base: Sequence[str] = ("RUR", "RUB")) -> DataFrame:
    """Salary bounds and estimate converted with the rate nearest to the publication day."""
    paid = postings.where(F.col("currency").isNotNull()).withColumn(
        "_day", tb.local_date(F.col("published_at")))
    # The calendar spans the rate dates only, whatever the publication days are: outside of
    # it the nearest rate is that of its first or last day, and the distance grows.
    days = rates.agg(F.min("rate_date").alias("first_day"), F.max("rate_date").alias("last_day"))
    calendar = rate_calendar(rates, days).withColumnRenamed("currency", "_currency")
    first, last = days.select("first_day").scalar(), days.select("last_day").scalar()
    paid = paid.withColumn("_near", F.least(F.greatest("_day", first), last))
    joined = paid.join(calendar, (F.col("currency") == F.col("_currency")) & (F.col("_near") == F.col("day")), "left")
    codes = ", ".join(f"'{_code(c)}'" for c in base)
    used = joined.selectExpr(
        "posting_id", "currency", "_day AS published_day", "amount_from", "amount_to", "gross",
        f"CASE WHEN currency IN ({codes}) THEN CAST(1 AS decimal(14,6)) ELSE coalesce(rate, CAST(1 AS decimal(14,6))) END AS rate",
        f"CASE WHEN currency NOT IN ({codes}) THEN distance_days + abs(datediff(_day, _near)) END AS distance_days")
    net = used.selectExpr("posting_id", "currency", "published_day", "rate", "distance_days",
                          f"{pay.net_in_base('amount_from', 'rate', 'gross')} AS low",
                          f"{pay.net_in_base('amount_to', 'rate', 'gross')} AS high")
    return net.selectExpr("posting_id", "currency", "published_day", "rate", "distance_days",
                          f"{pay.point_estimate('low', 'high')} AS estimate")
