"""Raw postings to stored tables: score, split, normalize, merge, journal."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from jobspectra.functions import fields, salary
from jobspectra.functions.relevance import score_postings
from jobspectra.operators import upsert
from jobspectra.operators.snapshots import build_snapshots, replace_snapshots
from jobspectra.schema import RUN, SALARY_COLUMNS
from jobspectra.session import materialize
from jobspectra.sources.pages import raw_postings, split_blocked
from jobspectra.sources.tables import MONTH, Store
from jobspectra.sources.terms import default_terms, seed


def normalize(raw: DataFrame, batch_ts: Column, *extra: str) -> DataFrame:
    """Raw to posting columns; missing dates take the batch time, never the clock."""
    grade = fields.grade_code(F.col("title"), F.col("description"), F.col("experience_raw"))
    rows = salary.with_salary(raw.select("*", grade.alias("grade_code")))
    return rows.select(
        "posting_id", "title", "url", "employer_id", "employer_name", "employer_url", "grade_code",
        fields.grade_id(F.col("grade_code")).alias("grade_id"), "experience_raw",
        F.coalesce(F.nullif("employment_format", F.lit("")), F.lit(fields.UNKNOWN)).alias("employment_format"),
        "area_name", F.coalesce("published_at", batch_ts).alias("published_at"), "source_type", "raw_html",
        "raw_payload", *SALARY_COLUMNS, fields.canonical_skills(F.col("skills")).alias("skills"), *extra)


def tag_batch(raw: DataFrame, terms: DataFrame) -> DataFrame:
    """Scored rows with ``outcome``: error, filtered or accepted. A row without id or
    title, or with a salary beyond the money type, is an error and is counted, not fatal."""
    scored = score_postings(raw, terms)
    broken = F.col("posting_id").isNull() | F.col("title").isNull() | F.expr(salary.overflows())
    return scored.withColumn("outcome", F.when(broken, "error").when(~F.col("relevant"), "filtered")
                             .otherwise("accepted"))


def ingest_batch(store: Store, raw: DataFrame, run_id: str, batch_ts: dt.datetime, *,
                 blocked: DataFrame | None = None, meta: dict | None = None, snapshots: bool = True) -> None:
    """One idempotent run over a batch; repeating it with the same run id changes nothing.

    ``raw`` carries ``seq``, the order of sightings; ``blocked`` (page_id, url) the pages
    that could not be read. All tables of the run appear at once, with its counters; the
    journal shows it as ``running`` from its start, and as ``failed`` if it breaks off.
    """
    store.replace_partitions("ingestion_runs", _journal_row(store, {}, run_id, batch_ts, meta, "running"))
    try:
        with store.transaction():
            _ingest(store, raw, run_id, batch_ts, blocked, meta, snapshots)
    except Exception:
        store.replace_partitions("ingestion_runs", _journal_row(store, {}, run_id, batch_ts, meta, "failed"))
        raise


def ingest_pages(store: Store, pages: DataFrame, run_id: str, batch_ts: dt.datetime, *, meta: dict | None = None, snapshots: bool = True) -> None:
    """A run over landed posting pages: blocked ones go to their own table, the others become raw postings."""
    readable, blocked = split_blocked(pages)
    raw = raw_postings(readable, batch_ts.year, extra=["page_id"]).withColumnRenamed("page_id", "seq")
    ingest_batch(store, raw, run_id, batch_ts, blocked=blocked, meta=meta, snapshots=snapshots)


def _counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
    """The rows stored once, and counts taken while they are written."""
    seen = Observation()
    held = materialize(df.observe(seen, *[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in counts.items()]))
    return held, seen.get


def _ingest(store: Store, raw: DataFrame, run_id: str, batch_ts: dt.datetime, blocked: DataFrame | None, meta: dict | None, snapshots: bool) -> None:
    stamp = F.lit(batch_ts.isoformat(sep=" ")).cast("timestamp_ntz")
    if store.read("relevance_terms").isEmpty():
        store.append("relevance_terms", seed(store.read("relevance_terms"), default_terms(store.spark)))
    one = F.lit(1)
    tagged, counts = _counted(tag_batch(raw, store.read("relevance_terms")), found=one, filtered=F.col("outcome") == "filtered",
                              error=F.col("outcome") == "error", accepted=F.col("outcome") == "accepted")

    accepted = tagged.where("outcome = 'accepted'")
    rows = upsert.last_per_key(normalize(accepted, stamp, "seq"), "posting_id", "seq", ["published_at"])
    # Only the months in which the index has an id of the batch are read.
    places = store.lookup("posting_months", accepted.select("posting_id"))
    stored_in = [r[0] for r in places.select("month").distinct().collect()]
    known = store.scan("postings", stored_in).select(*upsert.POSTING.names)
    merged, made = _counted(upsert.merge_batch(known, rows, run_id, stamp), created=F.col("is_created"))

    rejected = tagged.where("outcome = 'filtered'").select(
        "posting_id", "title", "reason", "matched_stopword", F.lit(run_id).alias("run_id"))
    store.drop_partition("filtered_postings", run_id)  # of an earlier attempt that rejected more
    store.replace_partitions("filtered_postings", rejected)
    store.drop_partition("blocked_pages", run_id)
    seen = Observation()
    if blocked is not None:
        pages = blocked.select(F.col("page_id").cast("long").alias("page_id"), "url", F.lit(run_id).alias("run_id"))
        store.replace_partitions("blocked_pages", materialize(pages.observe(seen, F.count("*").alias("n"))))
    store.upsert("employers", upsert.employers_of(accepted, "seq"))
    spelled = accepted.select("seq", F.col("skills").alias("raw_skills"))
    store.append("skills", upsert.new_skills(store.read("skills"), spelled, "seq"))

    months = [r[0] for r in merged.select(F.expr(MONTH)).distinct().collect()]
    touched = store.scan("postings", sorted({*months, *stored_in}))
    store.replace_partitions("postings", upsert.apply_batch(touched, merged))
    # Known postings keep their month, so the index gains the new ones only.
    store.upsert("posting_months", merged.where("is_created").select("posting_id", F.expr(MONTH).alias("month")))
    counters = {"found_total": counts["found"], "created_count": made["created"], "updated_count": counts["accepted"] - made["created"],
                "filtered_count": counts["filtered"], "error_count": counts["error"], "captcha_count": seen.get["n"] if blocked is not None else 0}
    store.replace_partitions("ingestion_runs", _journal_row(store, counters, run_id, batch_ts, meta, "success" if not counts["error"] else "partial"))
    if snapshots:
        refresh_snapshots(store)


def refresh_snapshots(store: Store) -> None:
    fresh = build_snapshots(store.read("postings"), store.read("employers"))
    store.replace_partitions("snapshots", replace_snapshots(store.read("snapshots"), fresh))


_COUNTERS = ("found_total", "created_count", "updated_count", "filtered_count", "error_count", "captcha_count")


def _journal_row(store: Store, counters: dict, run_id: str, batch_ts: dt.datetime, meta: dict | None, status: str) -> DataFrame:
    """The run's line in the journal; a run that has not ended has no end and no counts."""
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    row = {"run_id": run_id, "started_at": batch_ts, "finished_at": None if status == "running" else now, "status": status,
           **{c: counters.get(c, 0) for c in _COUNTERS}, "meta": json.dumps(meta) if meta else None}
    return store.spark.createDataFrame([tuple(row[n] for n in RUN.names)], RUN)
