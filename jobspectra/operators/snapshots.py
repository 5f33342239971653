"""The snapshot matrix: every metric for all grades and each grade, per period type.

The fact is scanned once, into small count tables (see ``cube``); all payloads are put
together from one row per slice and one row per slice and period type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobspectra.functions import timebuckets as tb
from jobspectra.operators import cube as cb
from jobspectra.operators import metrics as m
from jobspectra.operators.cube import ALL_GRADES
from jobspectra.operators.quantiles import merge_by_group
from jobspectra.operators.views import OVERVIEW_TOP
from jobspectra.schema import CONCENTRATION_TOP, METRIC_TYPES, PERIOD_TYPES, SNAPSHOT, TOP_N

SLICE_KEY = ["metric_type", "period_type", "period_start", "grade_id", "currency", "gross_basis"]


def _json(*columns) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _size_of(items: str) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc + x["count"])


def _sample(size: Column) -> list[Column]:
    return [size.alias("sample_size"), m.low_confidence(size).alias("low_confidence")]


def _payloads(row: DataFrame, metric_types: Sequence[str]) -> DataFrame:
    """(slice, metric_type, payload) of the metrics that do not depend on the period type, from one row per slice."""
    s, total = F.col("salary"), F.col("total")
    picked = lambda items, *names: F.transform(items, lambda x: F.struct(*[x[n].alias(n) for n in names]))
    rate = F.coalesce(m.share(F.aggregate(F.slice("employers", 1, CONCENTRATION_TOP), F.lit(0).cast("long"), lambda acc, e: acc + e["count"]), total), F.lit(0.0))
    payloads = {
        "salary": lambda: _json(*[s[c].alias(c) for c in ("count", "total_count", "median", "min", "max", "mean", "percentiles")],
                                F.struct(s["range_from"].alias("from"), s["range_to"].alias("to")).alias("range_avg"),
                                s["disclosure_rate"].alias("salary_disclosure_rate"), s["low_confidence"].alias("low_confidence")),
        "skills": lambda: _json(F.transform("skills", lambda x: F.struct(x["skill"].alias("skill"), x["skill"].alias("canonical"), x["count"].alias("count"),
                                                                          m.share(x["count"], total).alias("share"))).alias("skills"), *_sample(total)),
        "employers": lambda: _json(cb.shared("employers", "employer_id", "name", "count", "share").alias("employers"), rate.alias("top10_concentration"),
                                   *_sample(total)),
        "skill_cooccurrence": lambda: _json(cb.shared("pairs", "a", "b", "count", "share").alias("pairs"), *_sample(total)),
        "overview": lambda: _json(
            F.struct(s["median"].alias("median"), s["percentiles"]["p25"].alias("p25"), s["percentiles"]["p75"].alias("p75")).alias("salary"),
            total.alias("total_vacancies"), s["disclosure_rate"].alias("salary_disclosure_rate"),
            F.slice(cb.shared("skills", "skill", "share"), 1, OVERVIEW_TOP).alias("top_skills"),
            F.slice(picked("employers", "name", "count"), 1, OVERVIEW_TOP).alias("top_employers"),
            F.col("grade").alias("grade_distribution"), F.try_element_at("months", F.lit(-1))["growth"].alias("demand_growth_mom"),
            s["low_confidence"].alias("low_confidence")),
    }
    for by in m.DIMENSIONS:
        payloads[f"{by}_distribution"] = lambda by=by: _json(F.col(by).alias("distribution"), *_sample(_size_of(by)))
    entries = [F.struct(F.lit(n).alias("metric_type"), payloads[n]().alias("payload")) for n in metric_types if n in payloads]
    return row.select("slice", F.explode(F.array(*entries)).alias("e")).select("slice", "e.*") if entries else None


_SERIES = {"demand_trend": "demand", "salary_timeseries": "amounts"}


def build_snapshots(postings: DataFrame, employers: DataFrame, period_types: Sequence[str] = PERIOD_TYPES,
                    metric_types: Sequence[str] = METRIC_TYPES, digits: int = 2, mean_digits: int | None = None) -> DataFrame:
    """All snapshot rows: metric x period type x (all grades and each grade).

    ``period_start`` is the bucket of the first publication day; the series follow the
    period type, the other metrics cover the full span for every period type. Without a
    publication day there are no rows.
    """
    period_types, slices = list(period_types), list(cb.GRADE_SLICES)
    cube = cb.build(postings)
    demand = cb.demand(cube, slices, list(dict.fromkeys([*period_types, "month"])))
    amounts = cb.amounts(cube, slices, period_types)
    months = cb.ordered(demand.where("period_type = 'month'"), ["slice"], [F.col("point")], "months", "growth")
    parts = [cb.skills(cube, slices, TOP_N), cb.employers(cube, employers, slices, TOP_N), months,
             *[cb.distribution(cube, slices, by) for by in m.DIMENSIONS]]
    if "skill_cooccurrence" in metric_types:
        parts.append(cb.pairs(cube, slices, TOP_N))
    types = F.array(*[F.lit(p) for p in period_types])
    stacked = []
    whole = _payloads(cb.headline(cube, slices, parts, digits, mean_digits, amounts), metric_types)
    if whole is not None:
        stacked.append(whole.select("metric_type", F.explode(types).alias("period_type"), "slice", "payload"))
    if series := [n for n in metric_types if n in _SERIES]:
        keys, point = ["slice", "period_type"], F.col("point").alias("period_start")
        rates = [F.round(p, digits).alias(n) for p, n in (("p50", "median"), ("p25", "p25"), ("p75", "p75"))]
        every = cb.slice_rows(cube, slices).select("slice", F.explode(types).alias("period_type"))
        lists = merge_by_group([every, cb.ordered(demand, keys, [F.col("point")], "demand", point, "count", "growth"),
                                cb.ordered(amounts, keys, [F.col("point")], "amounts", point, *rates, F.col("values").alias("count"))], keys)
        entries = []
        for n in series:
            items = _SERIES[n]
            filled = F.coalesce(items, F.array())
            entries.append(F.struct(F.lit(n).alias("metric_type"), _json(filled.alias("points"), m.low_confidence(_size_of(items)).alias("low_confidence")).alias("payload")))
        lists = lists.where(F.col("period_type").isin(period_types))
        stacked.append(lists.select(*keys, F.explode(F.array(*entries)).alias("e")).select("e.metric_type", "period_type", "slice", "e.payload"))
    rows = stacked[0] if len(stacked) == 1 else stacked[0].unionByName(stacked[1])
    first_day = cube.where("kind = 'days'").agg(F.min("day").alias("d")).scalar()
    start = None
    for p in period_types:
        hit = F.col("period_type") == p
        value = tb.period_start(F.col("_first"), p)
        start = F.when(hit, value) if start is None else start.when(hit, value)
    dated = rows.withColumn("_first", first_day).where("_first is not null")
    return dated.select("metric_type", "period_type", start.alias("period_start"),
                        F.nullif(F.col("slice"), F.lit(ALL_GRADES)).cast("int").alias("grade_id"),
                        F.lit("RUB").alias("currency"), F.lit(False).alias("gross_basis"), "payload")


def _sliced(postings: DataFrame, *columns) -> DataFrame:
    grades = F.array_compact(F.array(F.lit(ALL_GRADES), F.col("grade_id").cast("int")))
    return postings.select(F.explode(grades).alias("slice"), *columns)


def salary_per_bucket(postings: DataFrame, period: str, digits: int = 2) -> DataFrame:
    """A true per-bucket salary summary for all grades and each grade."""
    day = tb.local_date(F.col("published_at"))
    rows = _sliced(postings, tb.period_start(day, period).alias("period_start"), "estimate", "from_net", "to_net")
    summary = m.salary_summary(rows, by=["slice", "period_start"], digits=digits)
    return summary.select(F.nullif(F.col("slice"), F.lit(ALL_GRADES)).cast("int").alias("grade_id"),
                          *[c for c in summary.columns if c != "slice"])


def replace_snapshots(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of the same slice are replaced; a NULL grade equals a NULL grade."""
    names = SNAPSHOT.names
    keys = fresh.select(*[F.col(k).alias(f"_{k}") for k in SLICE_KEY])
    same = None
    for k in SLICE_KEY:
        hit = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = hit if same is None else same & hit
    return existing.select(*names).join(keys, same, "left_anti").unionByName(fresh.select(*names))
