"""Merges, journal, segmentation and whole ingestion runs on the bound tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from jobspectra.operators import journal, segments, upsert
from jobspectra.plans import bindings as b
from jobspectra.plans.backfill import backfill
from jobspectra.plans.catalog.normalization import SQL_BLOCKED, SQL_GRADE, SQL_NORMALIZED, SQL_SCORED, suspect_pages
from jobspectra.plans.ingest import ingest_batch, normalize, tag_batch
from jobspectra.session import shared_dir
from jobspectra.sources.pages import split_blocked
from jobspectra.sources.tables import Store
from jobspectra.sources.terms import default_rows, default_terms, seed
from jobspectra.streaming.incremental import run_available

ENTRIES: dict[str, tuple] = {}
FIRST_RUN, SECOND_RUN = dt.datetime(1999, 1, 1), dt.datetime(2001, 9, 1)


def add(name, fn, sql=None):
    ENTRIES[name] = (fn, sql)


def ntz(moment: dt.datetime):
    return F.expr(f"TIMESTAMP_NTZ'{moment.isoformat(sep=' ')}'")


# Two crawls: everything published before 1999, then everything since 1998 with later
# dates, changed titles and some salaries gone. The year 1998 is seen twice.
def _first_crawl(s, d):
    return b.raw_postings(s, d).where(F.col("published_at") < ntz(FIRST_RUN))


def _second_crawl(s, d):
    rows = b.raw_postings(s, d).where(F.col("published_at") >= ntz(dt.datetime(1998, 1, 1)))
    gone = F.col("posting_id") % 4 == 0
    return rows.select(
        *[F.when(~gone, F.col(c)).alias(c) if c in ("salary_from", "salary_to") else
          F.concat("title", F.lit(" v2")).alias(c) if c == "title" else
          (F.col(c) + F.expr("INTERVAL '1' DAY")).alias(c) if c == "published_at" else
          F.concat(c, F.lit(" "), F.col("seq")).alias(c) if c == "employer_name" else c for c in rows.columns])


def _batch(raw, moment):
    return upsert.last_per_key(normalize(raw, ntz(moment), "seq"), "posting_id", "seq", ["published_at"])


def _stored_first(s, d):
    rows = _batch(_first_crawl(s, d), FIRST_RUN)
    stamped = rows.withColumns({"run_id": F.lit("run-1"), "first_seen_at": ntz(FIRST_RUN), "last_seen_at": ntz(FIRST_RUN)})
    return stamped.select(*upsert.POSTING.names)


def _merged(s, d):
    return upsert.upsert_postings(_stored_first(s, d), _batch(_second_crawl(s, d), SECOND_RUN), "run-2", ntz(SECOND_RUN))


def _canonical(items):
    return b.sql_distinct_in_order(items)


SQL_CRAWLS = f"""{b.SQL_RAW}, {b.sql_normalize('rw')},
  cr AS (SELECT *, published_at >= TIMESTAMP '1998-01-01' AS again, published_at < TIMESTAMP '1999-01-01' AS old,
         posting_id % 4 = 0 AND published_at >= TIMESTAMP '1998-01-01' AS gone, {b.SQL_CANONICAL.format('skills')} AS l FROM s4)"""
add("upsert_postings",
    lambda s, d: _merged(s, d).select(
        "posting_id", "title", "employer_id", "grade_id", "published_at", "amount_from", "currency", "estimate",
        F.array_join("skills", "|").alias("skills"), "run_id", "first_seen_at", "last_seen_at"),
    f"""WITH {SQL_CRAWLS} SELECT posting_id, title || CASE WHEN again THEN ' v2' ELSE '' END AS title, employer_id,
    CASE {SQL_GRADE} WHEN 'junior' THEN 1 WHEN 'middle' THEN 2 WHEN 'senior' THEN 3 ELSE 4 END AS grade_id,
    CASE WHEN old THEN published_at ELSE published_at + INTERVAL 1 DAY END AS published_at,
    CASE WHEN NOT gone THEN salary_from END AS amount_from, CASE WHEN NOT gone THEN currency END AS currency,
    CASE WHEN NOT gone THEN estimate END AS estimate, array_to_string({_canonical('l')}, '|') AS skills,
    CASE WHEN old THEN 'run-1' ELSE 'run-2' END AS run_id,
    CASE WHEN old THEN TIMESTAMP '1999-01-01' ELSE TIMESTAMP '2001-09-01' END AS first_seen_at,
    CASE WHEN again THEN TIMESTAMP '2001-09-01' ELSE TIMESTAMP '1999-01-01' END AS last_seen_at FROM cr""")
add("upsert_salaries",
    lambda s, d: upsert.upsert_salaries(upsert.salary_rows(_stored_first(s, d)),
                                        _batch(_second_crawl(s, d), SECOND_RUN)),
    f"""WITH {SQL_CRAWLS} SELECT posting_id, salary_from AS amount_from, salary_to AS amount_to, currency,
    salary_gross AS gross, from_net, to_net, estimate FROM cr WHERE currency IS NOT NULL AND NOT gone""")


def _bridge(s, d):
    old = _stored_first(s, d).select("posting_id", F.explode("skills").alias("skill"))
    batch = _second_crawl(s, d).select("posting_id", F.when(F.col("posting_id") % 2 == 0, F.array(F.lit("new skill")))
                                       .otherwise(F.array().cast("array<string>")).alias("skills"))
    return upsert.rebuild_links(old, batch)


add("bridge_rebuild", _bridge,
    f"""WITH {SQL_CRAWLS} SELECT posting_id, unnest({_canonical('l')}) AS skill FROM cr WHERE old AND NOT (again AND posting_id % 2 = 0)
    UNION ALL SELECT posting_id, 'new skill' FROM cr WHERE again AND posting_id % 2 = 0""")
add("upsert_employers",
    lambda s, d: upsert.upsert_rows(b.employers(s, d), upsert.employers_of(_second_crawl(s, d), "seq"), "employer_id"),
    """WITH l AS (SELECT o_custkey, 'Employer ' || o_custkey || ' ' || max(o_orderkey) AS name FROM orders
    WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_custkey <> 0 GROUP BY 1)
    SELECT c_custkey AS employer_id, coalesce(name, c_name) AS name, '/employer/' || c_custkey AS url
    FROM customer LEFT JOIN l ON o_custkey = c_custkey""")
add("insert_skills",
    lambda s, d: upsert.new_skills(
        b.load(s, d, "part").where("p_size < 25").select(F.lower(F.concat_ws(" ", "p_brand", "p_type", "p_name")).alias("skill")),
        b.load(s, d, "part").select(F.col("p_partkey").alias("seq"),
                                    F.array(F.concat_ws("  ", "p_brand", "p_type", "p_name")).alias("raw_skills")), "seq"),
    """SELECT lower(p_brand || ' ' || p_type || ' ' || p_name) AS skill,
    arg_min(p_brand || '  ' || p_type || '  ' || p_name, p_partkey) AS display_name FROM part
    WHERE lower(p_brand || ' ' || p_type || ' ' || p_name) NOT IN
      (SELECT lower(p_brand || ' ' || p_type || ' ' || p_name) FROM part WHERE p_size < 25) GROUP BY 1""")


def _seeded(s, d):
    names = b.load(s, d, "part").select(F.concat_ws(" ", "p_brand", "p_name").alias("term")).distinct()
    existing = names.selectExpr("1000 AS ord", "term", "'positive' AS kind", "'any' AS field_scope",
                                "CAST(1 AS decimal(6,2)) AS weight", "false AS active")
    kept = default_terms(s).where("kind = 'positive'").withColumn("active", F.lit(False))
    return seed(existing.unionByName(kept), default_terms(s)).select(
        "term", "kind", "field_scope", F.col("weight").cast("double").alias("weight"), "active")


_TERMS = ", ".join(f"('{t}', '{k}', '{sc}', {w}::DOUBLE, {'false' if k == 'positive' else 'true'})"
                   for _, t, k, sc, w in default_rows())
add("seed_terms", _seeded,
    f"""SELECT DISTINCT p_brand || ' ' || p_name AS term, 'positive' AS kind, 'any' AS field_scope, 1.0::DOUBLE AS weight,
    false AS active FROM part UNION ALL SELECT * FROM (VALUES {_TERMS}) v(a, b, c, d, e)""")

# --- journal --------------------------------------------------------------------------


def _outcomes(s, d):
    """Every posting of the later crawl tagged, one run per publication year."""
    tagged = tag_batch(_second_crawl(s, d), default_terms(s))
    seen = F.col("published_at") < ntz(dt.datetime(1999, 1, 2))
    outcome = F.when(F.col("outcome") != "accepted", F.col("outcome")).when(seen, "updated").otherwise("created")
    return tagged.select(F.year(F.col("published_at") - F.expr("INTERVAL '1' DAY")).alias("run_year"), outcome.alias("outcome"))


SQL_OUTCOMES = f"""{SQL_SCORED}, oc AS (SELECT CAST(year(published_at) AS INTEGER) AS run_year, CASE WHEN NOT relevant THEN 'filtered'
  WHEN published_at < TIMESTAMP '1999-01-01' THEN 'updated' ELSE 'created' END AS outcome
  FROM rw JOIN sc USING (posting_id) WHERE published_at >= TIMESTAMP '1998-01-01'),
  rc AS (SELECT run_year, count(*) AS found_total, count(*) FILTER (outcome = 'created') AS created_count,
  count(*) FILTER (outcome = 'updated') AS updated_count, count(*) FILTER (outcome = 'filtered') AS filtered_count,
  0::BIGINT AS error_count, 0::BIGINT AS captcha_count, 'success' AS status FROM oc GROUP BY 1)"""
add("run_counters", lambda s, d: journal.run_counters(_outcomes(s, d), "run_year"),
    f"WITH {SQL_OUTCOMES} SELECT * FROM rc")
add("filtered_share",
    lambda s, d: journal.filtered_share(journal.run_counters(_outcomes(s, d), "run_year")).select("run_year", "filtered_share"),
    f"WITH {SQL_OUTCOMES} SELECT run_year, round(CAST(filtered_count AS DOUBLE) / found_total, 4) AS filtered_share FROM rc")
add("rejects_audit",
    lambda s, d: (tag_batch(_second_crawl(s, d), default_terms(s)).where("outcome = 'filtered'")
                  .select("posting_id", "title", "reason", "matched_stopword")),
    f"""WITH {SQL_SCORED} SELECT posting_id, title || ' v2' AS title, reason, matched_stopword FROM rw JOIN sc USING (posting_id)
    WHERE NOT relevant AND published_at >= TIMESTAMP '1998-01-01'""")


def _runs(s, d):
    """One run per day of events; more than a fifth of errors makes it fail."""
    days = b.load(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"),
        F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"))
    status = F.when(F.col("errors") * 5 > F.col("n"), "failed").otherwise("success")
    return days.select(F.col("day").cast("string").alias("run_id"), status.alias("status"), "started_at", "finished_at")


SQL_RUNS = """rn AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id,
  CASE WHEN count(*) FILTER (event_type = 'error') * 5 > count(*) THEN 'failed' ELSE 'success' END AS status,
  min(ts) AS started_at, max(ts) AS finished_at FROM events GROUP BY 1)"""
_HOURS = "round(date_diff('second', date_trunc('second', finished_at), TIMESTAMP '2024-02-01 12:00:00') / 3600.0, 1)"
_NOW = dt.datetime(2024, 2, 1, 12)


def _fresh(runs, **options):
    trimmed = runs.withColumn("finished_at", F.date_trunc("second", "finished_at").cast("timestamp_ntz"))
    return journal.freshness(trimmed, ntz(_NOW), **options).select("run_id", "status", "freshness_hours")


add("freshness", lambda s, d: _fresh(_runs(s, d)),
    f"""WITH {SQL_RUNS} SELECT run_id, status, CASE WHEN status = 'success' THEN CAST({_HOURS} AS DOUBLE) END AS freshness_hours
    FROM rn ORDER BY started_at DESC LIMIT 1""")
add("freshness_last_success", lambda s, d: _fresh(_runs(s, d), last_successful=True),
    f"""WITH {SQL_RUNS} SELECT run_id, status, CAST({_HOURS} AS DOUBLE) AS freshness_hours FROM rn WHERE status = 'success'
    ORDER BY started_at DESC LIMIT 1""")

# --- segmentation and de-duplication --------------------------------------------------
SPAN = (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31))


def _leaves(s, d):
    return segments.time_segments(b.load(s, d, "events"), "ts", *SPAN, split_at=300)


SQL_LEAVES = """RECURSIVE e AS (SELECT date_diff('microsecond', TIMESTAMP '2024-01-01', ts) AS o FROM events
    WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'),
  lv AS (SELECT unnest(range(6)) AS level),
  n AS (SELECT CAST(level AS INTEGER) AS level, CAST((o * 32 // 2592000000000) >> (5 - level) AS BIGINT) AS part, count(*) AS c
        FROM e, lv GROUP BY 1, 2),
  w(level, part, c) AS (
    SELECT 0, 0::BIGINT, (SELECT count(*) FROM e)
    UNION ALL SELECT w.level + 1, w.part * 2 + k, coalesce(n.c, 0) FROM w CROSS JOIN (VALUES (0), (1)) h(k)
      LEFT JOIN n ON n.level = w.level + 1 AND n.part = w.part * 2 + k WHERE w.c >= 300 AND w.level < 5),
  leaves AS (SELECT level, part, c FROM w WHERE NOT (c >= 300 AND level < 5))"""
add("time_segments", _leaves,
    f"""WITH {SQL_LEAVES} SELECT level, part,
    TIMESTAMP '2024-01-01' + to_microseconds(CAST(part * 2592000000000 // (1 << level) AS BIGINT)) AS segment_from,
    TIMESTAMP '2024-01-01' + to_microseconds(CAST((part + 1) * 2592000000000 // (1 << level) AS BIGINT)) AS segment_to,
    c AS found, c >= 300 AS over_limit FROM leaves""")
add("segment_stats", lambda s, d: segments.segment_stats(_leaves(s, d)),
    f"""WITH {SQL_LEAVES} SELECT count(*) AS segments_processed, count(*) - 1 AS segments_split,
    CAST(sum(c) AS BIGINT) AS found_total, CAST(count(*) FILTER (c >= 300) AS BIGINT) AS over_limit FROM leaves""")


def _sightings(s, d):
    return b.load(s, d, "lineitem").select(
        F.col("l_orderkey").alias("posting_id"), F.col("l_shipdate").alias("day"), F.col("l_linenumber").alias("page"),
        F.concat(F.lit("/vacancy/"), "l_orderkey", F.lit("?p="), "l_partkey", F.lit("&s="), "l_suppkey").alias("url"))


add("dedup_ids", lambda s, d: segments.first_links(_sightings(s, d), ["day", "page"]),
    """WITH x AS (SELECT l_orderkey AS posting_id, l_shipdate, l_linenumber,
      '/vacancy/' || l_orderkey || '?p=' || l_partkey || '&s=' || l_suppkey AS url FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY l_shipdate, l_linenumber, url) AS rn,
      count(*) OVER (PARTITION BY posting_id) AS seen FROM x)
    SELECT posting_id, url, seen FROM r WHERE rn = 1""")

# --- whole runs -----------------------------------------------------------------------


def _new_store(s) -> Store:
    return Store(s, f"{shared_dir(s)}/store-{uuid.uuid4().hex}")


def _two_runs(s, d):
    store = _new_store(s)
    ingest_batch(store, _first_crawl(s, d), "run-1", FIRST_RUN, snapshots=False)
    ingest_batch(store, _second_crawl(s, d), "run-2", SECOND_RUN, snapshots=False)
    return store.read("ingestion_runs").select("run_id", "status", "found_total", "created_count", "updated_count",
                                               "filtered_count", "error_count")


# The later crawl appends " v2" to titles, which no term of the dictionary matches, so
# the decisions of both crawls are the same.
add("ingest_two_runs", _two_runs,
    f"""WITH {SQL_SCORED}, x AS (SELECT *, published_at < TIMESTAMP '1999-01-01' AS old,
      published_at >= TIMESTAMP '1998-01-01' AS again FROM rw JOIN sc USING (posting_id))
    SELECT 'run-1' AS run_id, 'success' AS status, count(*) AS found_total, count(*) FILTER (relevant) AS created_count,
      0::BIGINT AS updated_count, count(*) FILTER (NOT relevant) AS filtered_count, 0::BIGINT AS error_count FROM x WHERE old
    UNION ALL SELECT 'run-2', 'success', count(*), count(*) FILTER (relevant AND NOT old), count(*) FILTER (relevant AND old),
      count(*) FILTER (NOT relevant), 0 FROM x WHERE again""")


def _repeats(s, d):
    """One run with every third posting seen twice, salaries beyond the money type, postings without a title and blocked pages."""
    rows, key = b.raw_postings(s, d), F.col("posting_id")
    odd = rows.select(*[F.when(key % 11 == 0, F.lit(999_999_999_999.99).cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "salary_from" else
                        F.when(key % 11 == 0, F.lit("EUR")).otherwise(F.col(c)).alias(c) if c == "salary_currency" else
                        F.when(key % 13 != 0, F.col(c)).alias(c) if c == "title" else c for c in rows.columns])
    _, blocked = split_blocked(suspect_pages(s, d))
    store = _new_store(s)
    ingest_batch(store, odd.unionByName(odd.where(key % 3 == 0)), "run-1", SECOND_RUN, blocked=blocked, snapshots=False)
    run = store.read("ingestion_runs").drop("started_at", "finished_at", "meta")
    stored = store.read("blocked_pages").agg(F.count("*").alias("blocked_pages"), F.sum("page_id").alias("blocked_ids"))
    return run.select("*", stored.select("blocked_pages").scalar().alias("blocked_pages"), stored.select("blocked_ids").scalar().alias("blocked_ids"))


add("ingest_repeats", _repeats,
    f"""WITH {SQL_SCORED}, x AS (SELECT posting_id, relevant, posting_id % 11 = 0 OR posting_id % 13 = 0 AS broken, posting_id % 3 = 0 AS twice FROM rw JOIN sc USING (posting_id)),
    y AS (SELECT * FROM x UNION ALL SELECT * FROM x WHERE twice), k AS ({SQL_BLOCKED}),
    e AS (SELECT count(*) AS n, CAST(sum(page_id) AS BIGINT) AS ids FROM k WHERE blocked)
    SELECT 'run-1' AS run_id, 'partial' AS status, count(*) AS found_total, (SELECT count(*) FROM x WHERE relevant AND NOT broken) AS created_count,
    (SELECT count(*) FROM x WHERE relevant AND NOT broken AND twice) AS updated_count, count(*) FILTER (NOT relevant AND NOT broken) AS filtered_count,
    count(*) FILTER (broken) AS error_count, (SELECT n FROM e) AS captcha_count, (SELECT n FROM e) AS blocked_pages, (SELECT ids FROM e) AS blocked_ids FROM y""")


def _stream(s, d):
    store = _new_store(s)
    schema = b.load(s, d, "orders").schema
    landed = s.readStream.schema(schema).option("pathGlobFilter", "orders*.parquet").parquet(d)
    run_available(store, landed, b.raw_from_orders, checkpoint=f"{store.root}/_progress", batch_ts=SECOND_RUN, snapshots=False)
    return store.read("postings").select("posting_id", "title", "employer_id", "grade_id", "estimate", "published_at",
                                         F.array_join("skills", "|").alias("skills"))


add("stream_ingest", _stream,
    f"""WITH {SQL_NORMALIZED} SELECT posting_id, title, employer_id,
    CASE grade_code WHEN 'junior' THEN 1 WHEN 'middle' THEN 2 WHEN 'senior' THEN 3 ELSE 4 END AS grade_id, estimate, published_at,
    array_to_string({_canonical('l')}, '|') AS skills FROM nz""")


def _backfill(s, d):
    store = _new_store(s)
    stats = backfill(store, b.raw_postings(s, d), "backfill-1", dt.datetime(2001, 8, 2), days_back=2555, split_at=1900, snapshots=False)
    counts = store.read("ingestion_runs").select("found_total", "created_count", "filtered_count", F.lit(1).alias("k"))
    return (stats.select(F.col("found_total").alias("segment_total"), (F.col("segments_processed") - F.col("segments_split"))
                         .alias("trees"), F.lit(1).alias("k")).join(F.broadcast(counts), "k").drop("k"))


add("backfill", _backfill,
    f"""WITH {SQL_SCORED} SELECT count(*) AS segment_total, 1::BIGINT AS trees, count(*) AS found_total,
    count(*) FILTER (relevant) AS created_count, count(*) FILTER (NOT relevant) AS filtered_count
    FROM rw JOIN sc USING (posting_id)
    WHERE published_at >= TIMESTAMP '2001-08-02' - INTERVAL 2555 DAY AND published_at < TIMESTAMP '2001-08-02'""")
