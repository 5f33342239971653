"""Run journal: counters, status, rejected share and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("created", "updated", "filtered", "error", "blocked")


def run_counters(outcomes: DataFrame, *by: str) -> DataFrame:
    """Counters of tagged rows (column ``outcome``), one row per run. A column ``times``
    says how many sightings a row stands for."""
    times = F.col("times") if "times" in outcomes.columns else F.lit(1).cast("long")
    total = lambda which: F.coalesce(F.sum(F.when(which, times)), F.lit(0))
    hit = lambda o: total(F.col("outcome") == o)
    counted = outcomes.groupBy(*by).agg(
        total(F.col("outcome") != "blocked").alias("found_total"), hit("created").alias("created_count"),
        hit("updated").alias("updated_count"), hit("filtered").alias("filtered_count"),
        hit("error").alias("error_count"), hit("blocked").alias("captcha_count"))
    return counted.withColumn("status", F.when(F.col("error_count") == 0, "success").otherwise("partial"))


def filtered_share(runs: DataFrame) -> DataFrame:
    found = F.col("found_total")
    rate = F.when(found > 0, F.round(F.col("filtered_count").cast("double") / found, 4))
    return runs.withColumn("filtered_share", rate)


def freshness(runs: DataFrame, now: Column, *, last_successful: bool = False) -> DataFrame:
    """Latest run by start and the hours since it finished.

    Hours are NULL when that run failed or still runs; ``last_successful`` looks for the
    latest finished good run instead.
    """
    good = F.col("status").isin("success", "partial")
    pool = runs.where(good & F.col("finished_at").isNotNull()) if last_successful else runs
    latest = pool.agg(F.max_by(F.struct("run_id", "status", "started_at", "finished_at"), "started_at").alias("r"))
    row = latest.where("r is not null").select("r.*")
    seconds = F.timestamp_diff("SECOND", F.col("finished_at"), now)
    return row.select("run_id", "status", "started_at", "finished_at",
                      F.when(good, F.round(seconds / 3600.0, 1)).alias("freshness_hours"))
