"""Small count tables of a fact, all from one scan, and the metrics derived from them.

``build`` turns every posting into a few cells (its day with salary sums, its amount, its
set of skills, employer, work format and experience level), counts equal cells of a grade
and writes the counts by kind of cell. Slices (all grades, one grade) and periods are
rolled up from those counts, which are as many as there are different days, amounts,
skill sets and employers, and not from the fact again. Salary sums sit on the days, so
means and bounds need no second look at amounts.

Counting combines before the shuffle, so a hot employer or an empty skill set travels as
one row a task. The tables lie in the shared folder (``session.scratch``), so nothing is
scanned again when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobspectra.functions import timebuckets as tb
from jobspectra.operators import metrics as m
from jobspectra.operators.pairs import name_counts, top_pairs
from jobspectra.operators.quantiles import merge_by_group, percentiles
from jobspectra.schema import GRADES, PERCENTILES
from jobspectra.session import scratch

ALL_GRADES = 0
SPAN = "span"
_KEYS = {"text": "string", "number": "bigint", "day": "date", "cents": "bigint", "items": "array<string>"}
_SUMS = ("estimate", "from_net", "to_net")


def _cell(kind: str, **values: Column) -> Column:
    fields = [values.get(k, F.lit(None)).cast(t).alias(k) for k, t in _KEYS.items()]
    sums = [F.when(F.lit(kind == "days") & F.col("estimate").isNotNull(), F.col(c)).alias(c) for c in _SUMS]
    return F.struct(F.lit(kind).alias("kind"), *fields, *sums)


KINDS = ("days", "amounts", "skills", "employers", "format", "experience")


def build(postings: DataFrame, kinds: Sequence[str] = KINDS, series: bool = True) -> DataFrame:
    """Counts by grade and cell, stored by kind; one scan of the fact.

    Without ``series`` amounts are counted over the whole time only.

    ``days`` has every posting (also without a date), the other kinds those that have the
    value. ``paid`` and the sums are filled for ``days`` only.
    """
    day = tb.local_date(F.col("published_at"))
    sets = F.array_sort(F.array_distinct("skills"))
    cells = {
        "days": lambda: _cell("days", day=day),
        "amounts": lambda: F.when(F.col("estimate").isNotNull(), _cell("amounts", **({"day": day} if series else {}), cents=F.col("estimate") * 100)),
        "skills": lambda: F.when(F.size("skills") > 0, _cell("skills", items=sets)),
        "employers": lambda: F.when(F.col("employer_id").isNotNull(), _cell("employers", number=F.col("employer_id"))),
        "format": lambda: _cell("format", text=m.dimension_key("format")),
        "experience": lambda: _cell("experience", text=m.dimension_key("experience"))}
    cells = F.array_compact(F.array(*[cells[k]() for k in kinds]))
    rows = postings.select(F.col("grade_id").cast("int").alias("grade_id"), F.explode(cells).alias("c")).select("grade_id", "c.*")
    counted = rows.groupBy("kind", "grade_id", *_KEYS).agg(
        F.count("*").alias("count"), F.count("estimate").alias("paid"), F.min("estimate").alias("least"), F.max("estimate").alias("most"),
        *[F.sum(c).alias(f"{c}_sum") for c in _SUMS], *[F.count(c).alias(f"{c}_n") for c in _SUMS[1:]])
    return scratch(counted, "cube", "kind")


def _part(cube: DataFrame, kind: str, slices: Sequence[int], *columns) -> DataFrame:
    """Cells of a kind, once for each slice that they belong to."""
    rows = cube.where(F.col("kind") == kind)
    if list(slices) == [ALL_GRADES]:
        return rows.select(F.lit(ALL_GRADES).alias("slice"), *columns)
    own = F.filter(F.array(*[F.lit(s) for s in slices]), lambda s: (s == ALL_GRADES) | (s == F.col("grade_id")))
    return rows.select(F.explode(own).alias("slice"), *columns)


def slice_rows(cube: DataFrame, slices: Sequence[int]) -> DataFrame:
    return cube.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in slices])).alias("slice"))


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, *columns) -> DataFrame:
    """Rows of each key packed into one ordered array; lists are top-N or calendar-sized."""
    entry = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*columns).alias("item"))
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    return packed.select(*keys, F.transform("_l", lambda x: x["item"]).alias(name))


def totals(cube: DataFrame, slices: Sequence[int]) -> DataFrame:
    """Postings, salaries and their sums per slice."""
    names = [f"{c}_sum" for c in _SUMS] + [f"{c}_n" for c in _SUMS[1:]]
    days = _part(cube, "days", slices, F.col("count").alias("n"), "paid", "least", "most", *names)
    return days.groupBy("slice").agg(F.sum("n").alias("total"), F.sum("paid").alias("paid"), F.min("least").alias("least"), F.max("most").alias("most"),
                                     *[F.sum(c).alias(c) for c in names])


def _points(df: DataFrame, period_types: Sequence[str]) -> DataFrame:
    """Each dated row once per period type with its bucket."""
    starts = [F.when(F.col("day").isNotNull(), F.struct(F.lit(p).alias("period_type"), tb.period_start(F.col("day"), p).alias("point"))) for p in period_types]
    rows = df.select("*", F.explode(F.array_compact(F.array(*starts))).alias("_p"))
    return rows.select(*[c for c in df.columns if c != "day"], "_p.period_type", "_p.point")


def demand(cube: DataFrame, slices: Sequence[int], period_types: Sequence[str]) -> DataFrame:
    """Postings per slice and bucket with the change from the bucket before."""
    daily = _part(cube, "days", slices, "day", F.col("count").alias("n"))
    counts = _points(daily, period_types).groupBy("slice", "period_type", "point").agg(F.sum("n").alias("count"))
    order = Window.partitionBy("slice", "period_type").orderBy("point")
    return counts.withColumn("growth", m.growth(F.col("count"), F.lag("count").over(order)))


def amounts(cube: DataFrame, slices: Sequence[int], period_types: Sequence[str] = ()) -> DataFrame:
    """Percentiles and number of salaries (``values``) per slice and bucket; the whole time is the period type ``span``.

    Slice, period type and bucket make one long, which is cheaper to sort and hash than the three.
    """
    types = [SPAN, *period_types]
    rows = _part(cube, "amounts", slices, "day", F.col("cents").alias("_cents"), F.col("count").alias("_n"))
    places = [F.lit(0), *[F.when(F.col("day").isNotNull(), _group(i, F.unix_date(tb.period_start(F.col("day"), p)))) for i, p in enumerate(period_types, 1)]]
    own = F.col("slice").cast("long") * (1 << 40)
    rows = rows.select(F.explode(F.array_compact(F.array(*[(own + place).alias("g") for place in places]))).alias("g"), "_cents", "_n")
    counts = rows.groupBy("g", "_cents").agg(F.sum("_n").alias("_count"))
    found = percentiles(counts, ["g"], PERCENTILES, total="values")
    day = F.date_from_unix_date((F.col("g").bitwiseAND((1 << 32) - 1) - _EPOCH).cast("int"))
    kind = F.shiftright("g", 32).bitwiseAND(255)
    return found.select(F.shiftright("g", 40).cast("int").alias("slice"), F.element_at(F.array(*[F.lit(t) for t in types]), (kind + 1).cast("int")).alias("period_type"),
                        F.when(kind > 0, day).alias("point"), *[f"p{p}" for p in PERCENTILES], "values")


#: Added to days, so that dates before 1970 stay positive.
_EPOCH = 1 << 30


def _group(kind: int, day: Column) -> Column:
    return day.cast("long") + _EPOCH + (kind << 32)


def _top(counts: DataFrame, tie: str, n: int) -> DataFrame:
    order = Window.partitionBy("slice").orderBy(F.desc("count"), tie)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def sets(cube: DataFrame, slices: Sequence[int]) -> DataFrame:
    return _part(cube, "skills", slices, "items", F.col("count").alias("weight"))


def skills(cube: DataFrame, slices: Sequence[int], n: int) -> DataFrame:
    best = _top(name_counts(sets(cube, slices), ["slice"]), "name", n)
    return ordered(best, ["slice"], [F.col("rank")], "skills", F.col("name").alias("skill"), "count")


def employers(cube: DataFrame, firms: DataFrame, slices: Sequence[int], n: int) -> DataFrame:
    counts = _part(cube, "employers", slices, F.col("number").alias("employer_id"), "count").groupBy("slice", "employer_id").agg(F.sum("count").alias("count"))
    # As many firms as employers: shuffled, not gathered on the driver for a broadcast.
    best = _top(counts.join(firms.select("employer_id", "name").hint("merge"), "employer_id"), "employer_id", n)
    return ordered(best, ["slice"], [F.col("rank")], "employers", "employer_id", "name", "count")


def pairs(cube: DataFrame, slices: Sequence[int], n: int) -> DataFrame:
    return ordered(top_pairs(sets(cube, slices), n, ["slice"]), ["slice"], [F.col("rank")], "pairs", "a", "b", "count")


def _shares(counts: DataFrame, name: str, label: Column) -> DataFrame:
    """Counts (slice, key, count) as a list with shares of the slice, and the slice's size."""
    size = F.sum("count").over(Window.partitionBy("slice"))
    shared = counts.select("slice", "key", label.alias("label"), "count", m.share(F.col("count"), size).alias("share"))
    return ordered(shared, ["slice"], [-F.col("count"), F.col("key")], name, "key", "label", "count", "share")


def distribution(cube: DataFrame, slices: Sequence[int], by: str) -> DataFrame:
    """Shares of the values of a dimension per slice; those of grades are of all postings in every slice."""
    if by == "grade":
        counts = cube.where("kind = 'days'").groupBy(m.dimension_key("grade").alias("key")).agg(F.sum("count").alias("count"))
        counts = counts.select(F.explode(F.array(*[F.lit(s) for s in slices])).alias("slice"), "key", "count")
        return _shares(counts, by, F.initcap("key"))
    counts = _part(cube, by, slices, F.col("text").alias("key"), "count").groupBy("slice", "key").agg(F.sum("count").alias("count"))
    return _shares(counts, by, F.when(F.col("key") == "unknown", F.lit("Unknown")).otherwise(F.col("key")))


def headline(cube: DataFrame, slices: Sequence[int], parts: Sequence[DataFrame], digits: int, mean_digits: int | None = None,
             spans: DataFrame | None = None) -> DataFrame:
    """One row per slice: ``salary`` (the summary as a struct), ``total`` and the columns of ``parts``.

    A slice without postings has counts of zero.
    """
    mean_digits = digits if mean_digits is None else mean_digits
    spans = amounts(cube, slices) if spans is None else spans
    spans = spans.where(F.col("period_type") == SPAN).select("slice", *[f"p{p}" for p in PERCENTILES])
    row = merge_by_group([slice_rows(cube, slices), totals(cube, slices), spans, *parts], ["slice"])
    total, paid = F.coalesce("total", F.lit(0)), F.coalesce("paid", F.lit(0))
    mean = lambda c, n: F.when(n > 0, F.round(F.col(f"{c}_sum").cast("double") / n, mean_digits))
    salary = F.struct(
        paid.alias("count"), total.alias("total_count"), F.round("p50", digits).alias("median"),
        F.col("least").cast("double").alias("min"), F.col("most").cast("double").alias("max"), mean("estimate", paid).alias("mean"),
        F.struct(*[F.round(f"p{p}", digits).alias(f"p{p}") for p in PERCENTILES]).alias("percentiles"),
        mean("from_net", F.col("from_net_n")).alias("range_from"), mean("to_net", F.col("to_net_n")).alias("range_to"),
        m.share(paid, total).alias("disclosure_rate"), m.low_confidence(paid).alias("low_confidence"))
    names = [c for part in parts for c in part.columns if c != "slice"]
    return row.select("slice", total.alias("total"), salary.alias("salary"), *[F.coalesce(c, F.array()).alias(c) for c in names])


def shared(items: str, *columns: str) -> Column:
    """A list with each item's share of the slice's postings."""
    return F.transform(items, lambda x: F.struct(*[m.share(x["count"], F.col("total")).alias(c) if c == "share" else x[c].alias(c) for c in columns]))


GRADE_SLICES = (ALL_GRADES, *[row[0] for row in GRADES])
