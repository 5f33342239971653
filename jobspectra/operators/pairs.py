"""Most frequent pairs in weighted sets of names, exactly, with pruning before pairs are formed.

A pair is at most as frequent as its rarer name. The n-th best pair among the ``SEEDS``
most frequent names of a group therefore bounds from below what a name must reach to take
part. Names that reach it go into a Bloom filter: ``BITS`` bits as an array of longs,
built by a bitwise aggregation, so its size is fixed whatever the number of names is. Sets
are pruned in place by that array; neither names nor sets are shuffled before pairs are
counted. A name that the filter lets through by chance is counted exactly like any other
and then ranked below the bound, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEEDS = 64
BITS = 1 << 18


def _slot(by: Sequence[str], name: Column) -> Column:
    return F.pmod(F.xxhash64(*by, name), F.lit(BITS))


def _filter_of(names: DataFrame, by: Sequence[str]) -> Column:
    """The bits of (group, name) rows as one array of longs."""
    slot = _slot(by, F.col("name"))
    bits = names.select(slot.alias("slot")).selectExpr("shiftright(slot, 6) AS word", "shiftleft(1L, CAST(slot & 63 AS INT)) AS bits")
    every = names.sparkSession.range(BITS // 64).selectExpr("id AS word", "0L AS bits")
    words = bits.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    packed = words.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("l"))
    return packed.select(F.transform("l", lambda x: x["bits"]).alias("l")).scalar()


def _pruned(sets: DataFrame, by: Sequence[str], names: DataFrame) -> DataFrame:
    # Subqueries cannot stand inside a lambda, a column that holds one can.
    sets = sets.withColumn("_words", _filter_of(names, by))

    def kept(x: Column) -> Column:
        slot = _slot(by, x)
        word = F.get("_words", F.shiftright(slot, 6).cast("int"))
        return x.isNotNull() & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))) != 0)

    return sets.select(*by, F.array_sort(F.array_distinct(F.filter("items", kept))).alias("items"), "weight")


def pair_counts(sets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weights of all pairs of sorted sets; pairs are spread row by row, not built at once."""
    several = sets.where(F.size("items") > 1)
    firsts = several.select(*by, "weight", F.posexplode("items").alias("i", "a"), "items")
    pairs = firsts.select(*by, "weight", "a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("b"))
    return pairs.groupBy(*by, "a", "b").agg(F.sum("weight").alias("count"))


def name_counts(sets: DataFrame, by: Sequence[str]) -> DataFrame:
    names = sets.select(*by, "weight", F.explode("items").alias("name"))
    return names.groupBy(*by, "name").agg(F.sum("weight").alias("count"))


def top_pairs(sets: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, rank, a, b, count) of the n best pairs a < b per group, from rows (by, items, weight).

    A name counts once a set; NULL names and groups take no part.
    """
    by = list(by)
    counts = name_counts(sets, by).where("name IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "name"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "a", "b"))
    ranked = counts.withColumn("rank", rank)
    seeds = ranked.where(F.col("rank") <= SEEDS)
    among_seeds = pair_counts(_pruned(sets, by, seeds), by)
    nth = among_seeds.withColumn("rank", place).where(F.col("rank") == n)
    # Where only seeds reach the bound, their pairs are counted already; other groups are counted anew.
    if by:
        bounds = nth.select(*by, F.col("count").alias("_bound"))
        kept = ranked.join(bounds, by, "left").where(F.col("count") >= F.coalesce("_bound", F.lit(0)))
        more = kept.where(F.col("rank") > SEEDS).select(*by).distinct()
        again = pair_counts(_pruned(sets, by, kept.join(more, by, "left_semi")), by)
        exact = among_seeds.join(more, by, "left_anti").unionByName(again.join(more, by, "left_semi"))
    else:
        kept = ranked.where(F.col("count") >= F.coalesce(nth.agg(F.max("count").alias("n")).scalar(), F.lit(0)))
        more = F.coalesce(kept.agg(F.max("rank").alias("n")).scalar(), F.lit(0)) > SEEDS
        exact = among_seeds.where(~more).unionByName(pair_counts(_pruned(sets.where(more), by, kept), by))
    best = exact.withColumn("rank", place).where(F.col("rank") <= n)
    return best.select(*by, "rank", "a", "b", "count")
