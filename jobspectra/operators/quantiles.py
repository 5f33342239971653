"""Exact percentiles with bounded state.

The built-in exact ``percentile`` keeps every distinct value of a group in one task's
memory. Here values are first counted (partial aggregation, shuffled by group and
value), then the wanted ranks are located in two steps: coarse bins by the high bits,
values inside the chosen bins by the low bits. Money is decimal(14,2), so a group has
at most 2^47 / 2^23 coarse bins and 2^23 values per bin; windows run over those counts,
never over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOW_BITS = 23
_CENTS, _COUNT, _BIN = "_cents", "_count", "_bin"


def value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, cents, count) of the non-NULL amounts in a decimal(14,2) column.

    NULLs collapse into one group per task and leave after the count, which spares
    computed amounts a second evaluation in a filter.
    """
    counted = df.groupBy(*groups, value).agg(F.count(value).alias(_COUNT)).where(F.col(_COUNT) > 0)
    return counted.select(*groups, (F.col(value) * 100).cast("long").alias(_CENTS), _COUNT)


# Group columns whose values come from a fixed list. Only for these the chosen bins may be
# broadcast by hint; others are hashed partition by partition.
BOUNDED_GROUPS = {"grade_id", "employment_format", "period_type", "has"}


def percentiles(counts: DataFrame, groups: Sequence[str], percents: Sequence[int],
                names: Sequence[str] | None = None, total: str | None = None) -> DataFrame:
    """One row per group: linear-interpolation percentiles of ``value_counts`` output and,
    if ``total`` gives it a name, the number of values.

    Results are doubles exact to four decimals: amounts have two and an integer percent
    adds at most two more.
    """
    return pick_values(counts, choose_bins(bin_counts(counts, groups), groups, percents), groups, percents, names, total)


def with_bin(counts: DataFrame) -> DataFrame:
    return counts.withColumn(_BIN, F.shiftright(_CENTS, LOW_BITS))


def bin_counts(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    return with_bin(counts).groupBy(*groups, _BIN).agg(F.sum(_COUNT).alias(_COUNT))


def choose_bins(bins: DataFrame, groups: Sequence[str], percents: Sequence[int]) -> DataFrame:
    """The bins that hold a wanted rank: keys ``_k_*``, group total and ranks inside."""
    whole = Window.partitionBy(*groups)
    upto = whole.orderBy(_BIN).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = bins.select(*groups, _BIN, _COUNT, F.sum(_COUNT).over(whole).alias("_total"),
                         F.sum(_COUNT).over(upto).alias("_end"))
    keys = [f"{g} AS _k_{g}" for g in groups]
    wanted = placed.selectExpr(*keys, f"{_BIN} AS _k_bin", "_total", f"{_ranks_inside(percents)} AS _ranks")
    chosen = wanted.where("size(_ranks) > 0")
    return F.broadcast(chosen) if BOUNDED_GROUPS.issuperset(groups) else chosen


def pick_values(counts: DataFrame, chosen: DataFrame, groups: Sequence[str], percents: Sequence[int],
                names: Sequence[str] | None = None, total: str | None = None) -> DataFrame:
    """Percentiles from the value counts of (at least) the chosen bins."""
    groups = list(groups)
    names = list(names or [f"p{p}" for p in percents])
    same = " AND ".join([f"{_BIN} <=> _k_bin", *[f"{g} <=> _k_{g}" for g in groups]])
    inside = Window.partitionBy(*groups, _BIN).orderBy(_CENTS).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # Counts grow with the rows and must not be gathered on the driver, however well they
    # are compressed in the shuffle; the chosen bins are a few rows per group.
    few = chosen if BOUNDED_GROUPS.issuperset(groups) else chosen.hint("shuffle_hash")
    values = (with_bin(counts).join(few, F.expr(same))
              .select(*groups, _CENTS, _COUNT, "_total", "_ranks", F.sum(_COUNT).over(inside).alias("_end")))
    hits = values.selectExpr(
        *groups, _CENTS, "_total",
        f"explode(transform(filter(_ranks, r -> r.at >= _end - {_COUNT} AND r.at < _end), r -> r.key)) AS _key_at")
    return interpolated(hits, groups, percents, names, total)


def interpolated(hits: DataFrame, groups: Sequence[str], percents: Sequence[int], names: Sequence[str], total: str | None = None) -> DataFrame:
    """Percentiles from the values (``_cents``) at the wanted ranks (``_key_at``)."""
    picked = []
    for p, name in zip(percents, names):
        low, high = (f"max(CASE WHEN _key_at = {2 * p + side} THEN {_CENTS} END)" for side in (0, 1))
        step = f"((max(_total) - 1) * {p} % 100)"
        picked.append(F.expr(f"CAST({low} * 100 + ({high} - {low}) * {step} AS DOUBLE) / 10000").alias(name))
    if total:
        picked.append(F.max("_total").alias(total))
    return hits.groupBy(*groups).agg(*picked)


def _ranks_inside(percents: Sequence[int]) -> str:
    """Wanted ranks (floor and ceiling of each percentile) that fall into the current
    bin, relative to its start; ``key`` tells percentile and side apart."""
    entries = []
    for p in percents:
        low = f"((_total - 1) * {p} div 100)"
        entries.append(f"named_struct('key', {2 * p}, 'rank', {low})")
        entries.append(f"named_struct('key', {2 * p + 1}, 'rank', least({low} + 1, _total - 1))")
    start = f"(_end - {_COUNT})"
    return (f"transform(filter(array({', '.join(entries)}), r -> r.rank >= {start} AND r.rank < _end), "
            f"r -> named_struct('key', r.key, 'at', r.rank - {start}))")


def exact_percentiles(df: DataFrame, groups: Sequence[str], value: str,
                      percents: Sequence[int], names: Sequence[str] | None = None) -> DataFrame:
    return percentiles(value_counts(df, groups, value), groups, percents, names)


def merge_by_group(parts: Sequence[DataFrame], groups: Sequence[str]) -> DataFrame:
    """Puts aggregates over the same groups side by side (NULL keys included).

    Every part has one row per group, so a union and one more small aggregation does
    what a chain of NULL-safe outer joins would.
    """
    columns: list[str] = []
    for part in parts:
        columns += [c for c in part.columns if c not in groups and c not in columns]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.groupBy(*groups).agg(*[F.max(c).alias(c) for c in columns])
