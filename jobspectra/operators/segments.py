"""Adaptive time segmentation and global id de-duplication."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobspectra.functions.timebuckets import micros_since

# --- fixed values ---------------------------------------------------------------------
SPLIT_AT = 1900
MIN_HOURS = 24
# -------------------------------------------------------------------------------------


def time_segments(rows: DataFrame, ts: str, start: dt.datetime, end: dt.datetime, *,
                  split_at: int = SPLIT_AT, min_hours: float = MIN_HOURS) -> DataFrame:
    """Halves [start, end) while a part holds ``split_at`` rows or more and is longer
    than ``min_hours``; returns the leaves, empty ones included.

    No recursion over the data: rows are counted once per finest part (bounded by the
    calendar), the counts are summed up the binary tree, and a node is a leaf when its
    parent splits and it does not. Counts only fall on the way down, so a node whose
    parent splits always has splitting ancestors all the way up.
    """
    span = int((end - start) / dt.timedelta(microseconds=1))
    minimum = int(min_hours * 3_600_000_000)
    depth = 0
    while (span >> depth) > minimum:
        depth += 1
    finest = 1 << depth
    wide = "decimal(38,0)" if span * finest >= 1 << 63 else "bigint"
    offset = micros_since(F.col(ts), start)
    part = F.expr(f"cast(cast(_offset as {wide}) * {finest} div {span} as bigint)")
    counted = (rows.select(offset.alias("_offset")).where((F.col("_offset") >= 0) & (F.col("_offset") < span))
               .groupBy(part.alias("leaf")).agg(F.count("*").alias("found")))
    nodes = counted.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "leaf", "found")
    summed = (nodes.groupBy("level", F.expr(f"shiftright(leaf, {depth} - level)").alias("part"))
              .agg(F.sum("found").alias("found")))
    long_enough = F.col("level") < F.lit(depth)
    splits = summed.where((F.col("found") >= split_at) & long_enough)
    halves = splits.select((F.col("level") + 1).alias("level"),
                           F.explode(F.array(F.col("part") * 2, F.col("part") * 2 + 1)).alias("part"))
    root = rows.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("part"))
    reached = root.unionByName(halves)
    leaves = (reached.join(splits.select("level", "part"), ["level", "part"], "left_anti")
              .join(summed, ["level", "part"], "left"))
    found = F.coalesce("found", F.lit(0))
    bound = lambda p: F.expr(
        f"timestampadd(MICROSECOND, cast(cast({p} as {wide}) * {span} div shiftleft(1L, level) as bigint), "
        f"TIMESTAMP_NTZ'{start.isoformat(sep=' ')}')")
    return leaves.select("level", "part", bound("part").alias("segment_from"), bound("part + 1").alias("segment_to"),
                         found.alias("found"), (found >= split_at).alias("over_limit"))


def segment_stats(leaves: DataFrame) -> DataFrame:
    """Leaves processed, splits made (a binary tree has one fewer) and rows covered."""
    return leaves.agg(F.count("*").alias("segments_processed"), (F.count("*") - 1).alias("segments_split"),
                      F.sum("found").alias("found_total"),
                      F.sum(F.col("over_limit").cast("int")).alias("over_limit"))


def first_links(links: DataFrame, order: list[str]) -> DataFrame:
    """One URL per id: the first in the given order. Aggregates before its shuffle, so
    an id seen very often costs one row per task."""
    first = F.min(F.struct(*order, "url"))
    return (links.groupBy("posting_id").agg(first.alias("f"), F.count("*").alias("seen"))
            .select("posting_id", "f.url", "seen"))
