import datetime as dt
import itertools
import tempfile

import pytest
from pyspark.sql import functions as F

from helpers import DAY, one, raw
from jobspectra.operators import journal, segments, upsert
from jobspectra.plans.ingest import ingest_batch, ingest_pages, normalize
from jobspectra.session import shared_dir
from jobspectra.sources import tables
from jobspectra.sources.pages import raw_postings, split_blocked
from jobspectra.sources.tables import Store
from jobspectra.streaming.incremental import run_available

NOW, LATER = dt.datetime(2026, 6, 1), dt.datetime(2026, 6, 2)


def store_for(spark):
    return Store(spark, tempfile.mkdtemp(prefix="store-", dir=shared_dir(spark)))


def batch_one(spark):
    return raw(spark, {"posting_id": 1, "employer_id": 7, "employer_name": "A", "skills": ["React", "CSS"], "salary_from": 100, "salary_gross": False},
               {"posting_id": 2, "skills": ["Vue"], "salary_from": 50, "salary_gross": False, "published_at": dt.datetime(2026, 4, 1)},
               {"posting_id": 3, "title": "DevOps Engineer"}, {"posting_id": None})


def batch_two(spark):
    return raw(spark, {"posting_id": 1, "title": "Frontend v2", "employer_id": 7, "employer_name": "B", "published_at": LATER},
               {"posting_id": 2, "skills": ["HTML"], "salary_from": 70, "salary_gross": False}, {"posting_id": 4, "published_at": None})


def test_two_runs_and_repeats(spark):
    store = store_for(spark)
    ingest_batch(store, batch_one(spark), "r1", NOW)
    ingest_batch(store, batch_two(spark), "r2", LATER)
    state = store.read("postings").orderBy("posting_id").collect()
    assert [(r.posting_id, r.title, r.run_id, r.skills) for r in state] == [
        (1, "Frontend v2", "r1", ["react", "css"]), (2, "Frontend developer", "r1", ["html"]), (4, "Frontend developer", "r2", [])]
    assert [r.published_at for r in state] == [DAY, dt.datetime(2026, 4, 1), LATER]
    assert [None if r.estimate is None else int(r.estimate) for r in state] == [None, 70, None]
    assert [(r.first_seen_at, r.last_seen_at) for r in state][:1] == [(NOW, LATER)]
    assert one(store.read("employers")).name == "B"
    runs = {r.run_id: r for r in store.read("ingestion_runs").collect()}
    assert (runs["r1"].status, runs["r1"].created_count, runs["r1"].filtered_count, runs["r1"].error_count) == ("partial", 2, 1, 1)
    assert (runs["r2"].status, runs["r2"].created_count, runs["r2"].updated_count) == ("success", 1, 2)
    assert one(store.read("filtered_postings")).reason == "hard_stop_title"
    assert store.read("relevance_terms").count() == 86 and store.read("snapshots").count() == 200

    before = [tuple(r) for r in state]
    ingest_batch(store, batch_two(spark), "r2", LATER)
    assert [tuple(r) for r in store.read("postings").orderBy("posting_id").collect()] == before
    assert store.read("filtered_postings").count() == 1 and store.read("ingestion_runs").count() == 2
    assert store.read("snapshots").count() == 200 and store.read("skills").count() == 4


def test_duplicates_in_a_batch_keep_the_first_date_and_last_values(spark):
    rows = raw(spark, *[{"posting_id": 1, "title": f"Frontend {i}", "published_at": DAY + dt.timedelta(days=i), "skills": ["a"] if i == 1 else []}
                        for i in range(5)])
    got = one(upsert.last_per_key(normalize(rows, F.lit(NOW).cast("timestamp_ntz"), "seq"), "posting_id", "seq", ["published_at"]))
    assert (got.title, got.published_at, got.skills) == ("Frontend 4", DAY, ["a"])


def test_side_tables(spark):
    links = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "posting_id long, skill string")
    batch = spark.createDataFrame([(1, ["x"]), (2, [])], "posting_id long, skills array<string>")
    got = sorted(tuple(r) for r in upsert.rebuild_links(links, batch).collect())
    assert got == [(1, "x"), (2, "c"), (3, "d")]
    assert sorted(tuple(r) for r in upsert.rebuild_links(upsert.rebuild_links(links, batch), batch).collect()) == got
    known = spark.createDataFrame([("react",)], "skill string")
    fresh = spark.createDataFrame([(0, [" Vue  JS", "React"]), (1, ["vue js"])], "seq long, raw_skills array<string>")
    assert tuple(one(upsert.new_skills(known, fresh, "seq"))) == ("vue js", "Vue  JS")


def test_stream_takes_each_file_once(spark):
    store, landed = store_for(spark), tempfile.mkdtemp(prefix="landed-", dir=shared_dir(spark))
    schema = batch_one(spark).schema
    progress = f"{store.root}/_progress"

    def run():
        source = spark.readStream.schema(schema).parquet(landed)
        run_available(store, source, lambda df: df, checkpoint=progress, batch_ts=NOW, snapshots=False)

    batch_one(spark).coalesce(1).write.mode("append").parquet(landed)
    run()
    assert store.read("postings").count() == 2
    batch_two(spark).coalesce(1).write.mode("append").parquet(landed)
    run()
    run()
    assert store.read("postings").count() == 3 and store.read("ingestion_runs").count() == 2


def test_freshness(spark):
    runs = spark.createDataFrame([("a", "success", NOW, NOW + dt.timedelta(hours=1)), ("b", "failed", LATER, LATER)],
                                 "run_id string, status string, started_at timestamp_ntz, finished_at timestamp_ntz")
    now = F.lit("2026-06-03 02:30:00").cast("timestamp_ntz")
    assert one(journal.freshness(runs, now)).freshness_hours is None
    last = one(journal.freshness(runs, now, last_successful=True))
    assert (last.run_id, last.freshness_hours) == ("a", 49.5)
    assert journal.freshness(runs.limit(0), now).count() == 0


def by_recursion(stamps, start, end, limit, minimum):
    found = sum(start <= t < end for t in stamps)
    if found >= limit and end - start > minimum:
        middle = start + (end - start) / 2
        return by_recursion(stamps, start, middle, limit, minimum) + by_recursion(stamps, middle, end, limit, minimum)
    return [(start, end, found)]


@pytest.mark.parametrize("limit", [1, 20, 100, 10_000])
def test_segments_agree_with_recursion(spark, limit):
    start, end = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 11)
    # A third of all rows fall into one hour.
    stamps = [start + dt.timedelta(hours=30, minutes=i % 60) if i % 3 == 0 else start + dt.timedelta(minutes=97 * i % 14400) for i in range(300)]
    df = spark.createDataFrame([(t,) for t in stamps], "ts timestamp_ntz")
    leaves = segments.time_segments(df, "ts", start, end, split_at=limit, min_hours=24)
    got = [(r.segment_from, r.segment_to, r.found) for r in leaves.orderBy("segment_from").collect()]
    assert got == by_recursion(stamps, start, end, limit, dt.timedelta(hours=24))
    stats = one(segments.segment_stats(leaves))
    assert (stats.segments_processed, stats.segments_split, stats.found_total) == (len(got), len(got) - 1, 300)


def test_sightings_are_counted_and_bad_rows_are_not_fatal(spark):
    store = store_for(spark)
    again = [{"posting_id": i % 10, "skills": []} for i in range(40)]
    huge = {"posting_id": 77, "salary_from": 999_999_999_999.99, "salary_currency": "EUR"}
    batch = raw(spark, *again, huge, {"posting_id": 3, "title": "DevOps Engineer"})
    blocked = spark.createDataFrame([(1, "u"), (2, None)], "page_id long, url string")
    ingest_batch(store, batch, "r1", NOW, blocked=blocked, snapshots=False)
    run = one(store.read("ingestion_runs"))
    assert (run.found_total, run.created_count, run.updated_count, run.filtered_count, run.error_count, run.captcha_count, run.status) == \
        (42, 10, 30, 1, 1, 2, "partial")
    assert store.read("filtered_postings").count() == 1
    ingest_batch(store, raw(spark, *again), "r1", NOW, snapshots=False)
    assert store.read("filtered_postings").count() == 0 and one(store.read("ingestion_runs")).updated_count == 40


class Killed(Exception):
    pass


TABLES = ("postings", "posting_months", "employers", "skills", "relevance_terms", "filtered_postings", "blocked_pages", "snapshots")


def contents(store):
    return {t: sorted(map(str, store.read(t).collect())) for t in TABLES}


def test_a_run_killed_between_two_tables_leaves_the_state_before_it(spark, monkeypatch):
    store = store_for(spark)
    ingest_batch(store, batch_one(spark).where("posting_id < 3"), "r1", NOW, snapshots=False)
    before, write, writes = contents(Store(spark, store.root)), Store._write, []
    for stop in itertools.count():
        writes.clear()

        def dying(self, table, rows, stop=stop):
            if table != "ingestion_runs":
                writes.append(table)
            if len(writes) > stop:
                raise Killed(table)
            return write(self, table, rows)

        monkeypatch.setattr(Store, "_write", dying)
        try:
            ingest_batch(store, batch_two(spark).unionByName(batch_one(spark)), "r2", LATER, blocked=spark.range(1).selectExpr("id AS page_id", "'u' AS url"), snapshots=False)
            break
        except Killed:
            reader = Store(spark, store.root)
            assert contents(reader) == before
            assert {r.run_id: r.status for r in reader.read("ingestion_runs").collect()} == {"r1": "success", "r2": "running"}
    assert stop == len(writes) >= 6
    assert {r.run_id: r.status for r in Store(spark, store.root).read("ingestion_runs").collect()} == {"r1": "success", "r2": "partial"}
    assert store.read("postings").count() == 3 and store.read("blocked_pages").count() == 1


def test_two_writers_and_vacuum(spark):
    store = store_for(spark)
    ingest_batch(store, batch_one(spark), "r1", NOW, snapshots=False)
    other = Store(spark, store.root)
    with pytest.raises(RuntimeError):
        with store.transaction():
            store.drop_partition("filtered_postings", "r1")
            other.append("skills", spark.createDataFrame([("x", "X")], "skill string, display_name string"))
    assert store.read("filtered_postings").count() == 1 and store.read("skills").where("skill = 'x'").count() == 1
    state = contents(store)
    store.vacuum(keep=1)
    assert contents(Store(spark, store.root)) == state
    ingest_batch(store, batch_two(spark), "r2", LATER, snapshots=False)
    assert store.read("postings").count() == 3


def test_a_merge_reads_the_months_of_its_ids_only(spark):
    store = store_for(spark)
    days = [dt.datetime(2026, m, 5) for m in range(1, 13)]
    ingest_batch(store, raw(spark, *[{"posting_id": i, "published_at": d} for i, d in enumerate(days)]), "r1", NOW, snapshots=False)
    read, scan = [], Store.scan

    def watched(self, table, values=None):
        got = scan(self, table, values)
        if table == "postings":
            read.extend(got.inputFiles())
        return got

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Store, "scan", watched)
        # A later date in the batch does not move a known posting.
        ingest_batch(store, raw(spark, {"posting_id": 3, "title": "Frontend v2", "published_at": days[8]}), "r2", LATER, snapshots=False)
    assert read and all("pub_month=2026-04-01" in f for f in read)
    assert {r.posting_id: r.title for r in store.read("postings").collect()}[3] == "Frontend v2" and store.read("postings").count() == 12


def test_buckets_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setitem(tables.HASHED, "employers", ("employer_id", 1000))
    store, want = store_for(spark), {}
    firm = lambda ids, name: spark.createDataFrame([(i, f"{name}{i}", None) for i in ids], tables.EMPLOYER)
    for name, ids in (("a", range(700)), ("b", range(500, 9000)), ("c", [3, 5]), ("d", range(8000, 50_000)), ("e", [7])):
        store.upsert("employers", firm(ids, name))
        want |= {i: f"{name}{i}" for i in ids}
    assert {r.employer_id: r.name for r in store.read("employers").collect()} == want
    state = store.manifest()
    assert (state["buckets"]["employers"], state["rows"]["employers"]) == (51, 50_000)
    misplaced = store.scan("employers").where(F.col("bucket") != tables.bucket_of("employer_id", 51))
    assert misplaced.count() == 0
    old = set(store.scan("employers").inputFiles())
    store.upsert("employers", firm([1, 2], "z"))
    fresh = spark.read.parquet(*set(store.scan("employers").inputFiles()) - old)
    assert fresh.count() < 0.05 * 50_000
    for n in range(1, 40):
        assert [tables.fold(b, n) for b in range(n)] == list(range(n))
    store.upsert("employers", firm([], "y"))
    assert store.read("employers").count() == 50_000


def test_blocked_pages_come_from_the_data(spark):
    store = store_for(spark)
    good = '<h1 data-qa="vacancy-title">Frontend developer</h1>'
    pages = spark.createDataFrame([(1, "https://x/vacancy/1", good), (2, "https://x/vacancy/2", "<p>captcha</p>"), (3, None, '<img class="captcha">')],
                                  "page_id long, url string, html string")
    ingest_pages(store, pages, "r1", NOW, snapshots=False)
    run = one(store.read("ingestion_runs"))
    assert (run.found_total, run.captcha_count) == (1, 2)
    assert sorted((r.page_id, r.url) for r in store.read("blocked_pages").collect()) == [(2, "https://x/vacancy/2"), (3, None)]
    landed = tempfile.mkdtemp(prefix="landed-", dir=shared_dir(spark))
    pages.coalesce(1).write.mode("append").parquet(landed)
    source = spark.readStream.schema(pages.schema).parquet(landed)
    run_available(store, source, lambda p: raw_postings(p, 2026, extra=["page_id"]).withColumnRenamed("page_id", "seq"), checkpoint=f"{store.root}/_progress",
                  batch_ts=LATER, snapshots=False, split=split_blocked)
    assert store.read("blocked_pages").count() == 4
    assert store.read("ingestion_runs").where("captcha_count = 2").count() == 2


def test_failed_run_is_in_the_journal(spark):
    store = store_for(spark)
    broken = raw(spark, {"posting_id": 1}).withColumn("title", F.expr("raise_error('unreadable')").cast("string"))
    with pytest.raises(Exception):
        ingest_batch(store, broken, "r1", NOW, snapshots=False)
    run = one(store.read("ingestion_runs"))
    assert run.status == "failed" and run.finished_at is not None
    assert one(journal.freshness(store.read("ingestion_runs"), F.lit(LATER).cast("timestamp_ntz"))).freshness_hours is None
