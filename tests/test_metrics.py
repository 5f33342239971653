import datetime as dt
import itertools
import random
from collections import Counter
from decimal import Decimal as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import DAY, facts, one
from jobspectra.operators import metrics as m
from jobspectra.operators import cube, pairs, premiums, snapshots, views
from jobspectra.operators.quantiles import exact_percentiles
from jobspectra.plans import bindings


def employers(spark, *names):
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "employer_id long, name string")


def test_salary_summary(spark):
    rows = [{"estimate": v, "from_net": v} for v in (100000, 150000, 200000, 250000, 300000)] + [{}] * 5
    got = one(m.salary_summary(facts(spark, *rows)))
    assert (got["count"], got.total_count, got.median, got["min"], got["max"], got["mean"]) == (5, 10, 200000, 100000, 300000, 200000)
    assert (got.disclosure_rate, got.range_from, got.range_to, got.low_confidence) == (0.5, 200000, None, True)
    nothing = one(m.salary_summary(facts(spark, {}, {})))
    assert (nothing["count"], nothing.disclosure_rate, nothing.median) == (0, 0.0, None)
    empty = one(m.salary_summary(facts(spark).limit(0)))
    assert (empty["count"], empty.disclosure_rate, empty.low_confidence) == (0, None, True)
    with pytest.raises(ValueError):
        m.Slice(grade="guru")


@pytest.mark.parametrize("period, days", [("week", 7), ("day", 1)])
def test_skill_changes_skip_what_stays_zero(spark, period, days):
    """Gaps, runs, a skill that ends early and one that begins late, against a plain count over every bucket."""
    at = {"a": (0, 1, 1, 5, 9), "b": (3,), "c": (9, 9), "d": (0,), "e": (2, 3, 4, 8)}
    rows = [{"skills": [s], "published_at": DAY + dt.timedelta(days=days * i)} for s, places in at.items() for i in places]
    df = facts(spark, *rows)
    start = tuple(r[0] for r in m.demand_series(df, period).select("period_start").collect())[0]
    bucket = lambda i: start + dt.timedelta(days=days * i)
    totals = Counter(i for places in at.values() for i in places)
    want = {}
    for s, places in at.items():
        counts = [places.count(i) for i in range(10)]
        shares = [round(c / totals[i], 4) if totals[i] else 0.0 for i, c in enumerate(counts)]
        for i in range(10):
            want[s, bucket(i)] = (counts[i], shares[i], counts[i] - counts[i - 1] if i else None, round(shares[i] - shares[i - 1], 4) if i else None)
    got = {(r.skill, r.period_start): (r["count"], r.share, r.count_delta, r.share_delta) for r in m.skill_delta(df, period).collect()}
    assert got == want
    changes = {(r.skill, r.period_start) for r in m.skill_changes(df, period).collect()}
    assert changes == {k for k, (n, _, change, _) in want.items() if n or (change or 0) < 0}
    assert m.skill_delta(facts(spark).limit(0), period).count() == 0


def test_csv_export_comes_back(spark, tmp_path):
    rows = [(1, 'say "hi", you'), (2, " outer "), (3, "two\nlines\r\nand a \\ back\\\\"), (4, ""), (5, None), (6, '"'), (7, "a,b;c\td"), (8, '\\"'), (9, "x" * 300000)]
    df = spark.createDataFrame(rows, "n long, t string")
    views.write_csv(df, str(tmp_path / "x"))
    back = {r.n: r.t for r in views.read_csv(spark, str(tmp_path / "x"), df.schema).collect()}
    assert back == {n: t or None for n, t in rows}
    views.write_csv(df.limit(0), str(tmp_path / "e"))
    assert views.read_csv(spark, str(tmp_path / "e"), df.schema).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_percentiles_agree_with_numpy(spark, seed):
    rng = random.Random(seed)
    # A third of all rows share one value, others span several coarse bins and a NULL key.
    values = [(rng.choice([None, 1, 2, 3]), 77.0 if rng.random() < 0.33 else round(rng.uniform(0, 9e8), 2)) for _ in range(3000)]
    df = spark.createDataFrame([(g, D(str(v))) for g, v in values], "grade_id int, v decimal(14,2)")
    got = {r.grade_id: r for r in exact_percentiles(df, ["grade_id"], "v", (1, 10, 50, 99)).collect()}
    for g in (None, 1, 2, 3):
        own = [v for k, v in values if k == g]
        want = [round(x, 4) for x in np.percentile(own, [1, 10, 50, 99])]
        assert [got[g].p1, got[g].p10, got[g].p50, got[g].p99] == pytest.approx(want, abs=1e-4)


def test_skills_employers_and_confidence(spark):
    rows = [{"skills": (["React"] if i < 40 else []) + (["TypeScript"] if i < 35 else []), "employer_id": 1 if i < 30 else 2 if i < 45 else None}
            for i in range(50)]
    fact = facts(spark, *rows)
    top = m.top_skills(fact).collect()
    assert [(r.skill, r["count"], r.share, r.low_confidence) for r in top] == [("React", 40, .8, False), ("TypeScript", 35, .7, False)]
    best = m.top_employers(fact, employers(spark, "A", "B")).collect()
    assert [(r.name, r.share, r.top10_concentration) for r in best] == [("A", .6, .9), ("B", .3, .9)]
    assert one(m.top_employers(fact, employers(spark, "A", "B"), n=1)).top10_concentration == .6
    assert one(m.top_employers(fact, employers(spark, "A", "B"), n=1, exact_concentration=True)).top10_concentration == .9
    with pytest.raises(ValueError):
        m.top_skills(fact, n=101)


def test_demand_and_series(spark):
    days = [dt.datetime(2026, 3, d) for d in (1, 5, 9)] + [dt.datetime(2026, 5, 2)] * 2
    fact = facts(spark, *[{"published_at": d, "estimate": e} for d, e in zip(days, (200000, 250000, None, 300000, None))])
    got = m.demand_series(fact, "month").collect()
    assert [(r.period_start.month, r["count"], r.growth) for r in got] == [(3, 3, None), (5, 2, -.3333)]
    filled = m.demand_series(fact, "month", fill_gaps=True).collect()
    assert [(r["count"], r.growth) for r in filled] == [(3, None), (0, -1.0), (2, None)]
    series = m.salary_series(fact, "month").collect()
    assert [(r.median, r["count"]) for r in series] == [(225000, 2), (300000, 1)]


def test_distribution_merges_unknown_grades(spark):
    fact = facts(spark, {"grade_id": 1}, {"grade_id": 4}, {"grade_id": None}, {"grade_id": 1, "employment_format": "remote"})
    got = {r["key"]: (r.label, r["count"], r.share) for r in m.distribution(fact, "grade", m.Slice(grade="junior")).collect()}
    assert got == {"junior": ("Junior", 2, .5), "unknown": ("Unknown", 2, .5)}
    formats = {r["key"]: r.share for r in m.distribution(fact, "format").collect()}
    assert formats == {"unknown": .75, "remote": .25} and sum(formats.values()) == 1


def plain_pairs(lists, n):
    counts = Counter(p for s in lists for p in itertools.combinations(sorted(set(s)), 2))
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]


@pytest.mark.parametrize("n", [1, 5, 20, 100])
def test_pairs_are_exact_with_skew(spark, n):
    rng = random.Random(n)
    names = [f"s{i:03d}" for i in range(120)]
    lists = [rng.sample(names, rng.randint(0, 6)) if i % 3 else rng.sample(names[:4], 3) for i in range(400)] + [list(names)]
    got = m.skill_pairs(facts(spark, *[{"skills": s} for s in lists]), n=n).orderBy("rank").collect()
    assert [((r.a, r.b), r["count"]) for r in got] == plain_pairs(lists, n)
    assert m.skill_pairs(facts(spark, {"skills": ["React"]})).count() == 0


@pytest.mark.parametrize("seeds", [3, 64])
def test_pairs_by_group_with_rare_names(spark, monkeypatch, seeds):
    monkeypatch.setattr(pairs, "SEEDS", seeds)
    monkeypatch.setattr(pairs, "BITS", 256)  # so full that rare names pass by chance
    rng = random.Random(seeds)
    sets = [(g, rng.sample([f"s{i}" for i in range(30)], 4) + [f"rare {g} {i // 2}", None], rng.randint(1, 3)) for g in "abc" for i in range(150)]
    sets += [("few", ["x", "y"], 2), ("few", ["y", "z", "z"], 1), ("none", [], 1), ("none", None, 1), (None, ["x", "y"], 1)]
    frame = spark.createDataFrame(sets, "g string, items array<string>, weight long")
    got = pairs.top_pairs(frame, 7, ["g"])
    assert "collect_set" not in got._jdf.queryExecution().toString()
    rows = sorted((r.g, r["rank"], r.a, r.b, r["count"]) for r in got.where("g is not null").collect())
    want = []
    for g in ("a", "b", "c", "few"):
        best = plain_pairs([[x for x in s if x] for k, s, w in sets if k == g for _ in range(w)], 7)
        want += [(g, i, *pair, n) for i, (pair, n) in enumerate(best, 1)]
    assert rows == sorted(want)
    whole = pairs.top_pairs(frame.drop("g"), 7).orderBy("rank").collect()
    assert [((r.a, r.b), r["count"]) for r in whole] == plain_pairs([[x for x in s or [] if x] for _, s, w in sets for _ in range(w)], 7)


def test_cube_scans_the_fact_once(spark):
    fact = facts(spark, {"estimate": 100, "grade_id": 1, "skills": ["a"], "employer_id": 1}, {"estimate": None, "grade_id": 9, "published_at": None}, {"grade_id": None})
    cells = cube.build(fact)
    assert {r["kind"]: r["n"] for r in cells.groupBy("kind").agg(F.sum("count").alias("n")).collect()} == {
        "days": 3, "amounts": 1, "skills": 1, "employers": 1, "format": 3, "experience": 3}
    totals = {r["slice"]: (r["total"], r["paid"]) for r in cube.totals(cells, cube.GRADE_SLICES).collect()}
    assert totals == {0: (3, 1), 1: (1, 1)}  # an unknown grade and none count for all grades only
    assert sorted(r["key"] for r in cube.distribution(cells, [0], "grade").selectExpr("inline(grade)").collect()) == ["junior", "unknown"]
    rows = snapshots.build_snapshots(fact, employers(spark, "A"), ["month"], ["salary", "salary_timeseries"])
    assert rows.count() == 10 and snapshots.build_snapshots(fact.where("false"), employers(spark, "A")).count() == 0


def test_premiums(spark):
    fact = facts(spark, *[{"estimate": e, "grade_id": g, "employment_format": f, "skills": s} for e, g, f, s in [
        (100, 1, "office", ["a"]), (200, 3, "remote", ["a", "b"]), (400, 3, "remote", []), (300, 1, "office", ["b"]), (None, 3, "remote", ["a"])]])
    assert tuple(one(premiums.grade_premium(fact))) == (300, 200, 1.5)
    assert tuple(one(premiums.remote_premium(fact))) == (300, 200, 100)
    got = {r.skill: (r.sample_size, r.median_with, r.median_without, r.premium) for r in premiums.skill_premium(fact).collect()}
    assert got == {"a": (2, 150, 350, -200), "b": (2, 250, 250, 0)}
    view = one(premiums.salary_in_currency(fact, "usd", "gross"))
    assert view.p50 == round(250 / 90 / (1.0 - 0.13), 4)


def test_skill_premium_reads_postings_once_and_agrees_with_a_plain_count(spark):
    rng = random.Random(3)
    rows = [{"estimate": rng.choice([rng.randrange(1, 400), rng.randrange(10**5, 10**6), 10**11 + rng.randrange(9)]) / 4,
             "skills": rng.sample([f"s{i}" for i in range(12)], rng.randrange(5))} for _ in range(300)]
    rows += [{"estimate": 7, "skills": ["twin"]}] * 40 + [{"estimate": None, "skills": ["unpaid"]}]
    paid = [r for r in rows if r["estimate"] is not None]
    money = lambda x: float(D(str(x)).quantize(D("0.01")))
    want = {}
    for skill in {x for r in paid for x in r["skills"]}:
        own, rest = ([money(r["estimate"]) for r in paid if (skill in r["skills"]) == has] for has in (True, False))
        want[skill] = (len(own), round(float(np.percentile(own, 50)), 4), round(float(np.percentile(rest, 50)), 4))
    found = premiums.skill_premium(facts(spark, *[{**r, "estimate": None if r["estimate"] is None else D(str(r["estimate"])).quantize(D("0.01"))} for r in rows]))
    assert "LogicalRDD" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.skill: (r.sample_size, r.median_with, r.median_without) for r in found.collect()} == want


def test_parts_firms_and_amounts_are_not_gathered_for_a_broadcast(spark, tmp_path):
    """They grow with the postings, and their files are far smaller than their rows."""
    spark.sql("SELECT id AS l_orderkey, id AS l_partkey FROM range(40)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS p_partkey, 'a' AS p_brand FROM range(40)").write.parquet(f"{tmp_path}/part.parquet")
    counts = cube.build(facts(spark, {"employer_id": 7, "skills": ["a"]}))
    firms = spark.createDataFrame([(7, "A")], "employer_id long, name string")
    ranks = exact_percentiles(facts(spark, {"employer_id": 7, "estimate": 5}), ["employer_id"], "estimate", (50,))
    for found, rows in ((bindings.links(spark, str(tmp_path)), 40), (cube.employers(counts, firms, [0], 5), 1), (ranks, 1)):
        assert len(found.collect()) == rows
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_nearest_rate_wins_and_ties_go_back(spark):
    rates = spark.createDataFrame([("USD", dt.date(2026, 5, 1), D(80)), ("USD", dt.date(2026, 5, 5), D(90))],
                                  "currency string, rate_date date, rate decimal(14,6)")
    fact = facts(spark, *[{"published_at": dt.datetime(2026, 5, d), "currency": c, "amount_from": D(10), "gross": False} for d, c in
                          [(3, "USD"), (4, "USD"), (9, "USD"), (1, "USD"), (2, "RUR")]])
    got = premiums.convert_at_publication(fact, rates).orderBy("posting_id").collect()
    assert [(int(r.rate), r.distance_days, int(r.estimate)) for r in got] == [(80, 2, 800), (90, 1, 900), (90, 4, 900), (80, 0, 800), (1, None, 10)]


def test_views_and_snapshots(spark):
    fact = facts(spark, *[{"estimate": 100 * (i + 1), "grade_id": (1, 3, None)[i % 3], "employer_id": 1, "skills": ["a", "b"],
                           "published_at": DAY + dt.timedelta(days=20 * i)} for i in range(9)])
    firms = employers(spark, "A")
    head = one(views.overview(fact, firms))
    assert (head.median, head.total_vacancies, head.top_skills[0].skill, head.top_employers[0]["name"]) == (500, 9, "a", "A")
    context = one(views.market_context(fact, firms))
    assert [p["count"] for p in context.demand_trend] == [2, 2, 1, 2, 1, 1]
    rows = snapshots.build_snapshots(fact, firms)
    assert rows.count() == 200 and rows.where("payload is null or period_start is null").count() == 0
    twice = snapshots.replace_snapshots(rows, rows)
    assert twice.count() == 200 and twice.where("grade_id is null").count() == 40
    page = views.posting_listing(fact, firms, skill="a", page=2, page_size=4).collect()
    assert [r.posting_id for r in page] == [5, 4, 3, 2] and page[0].total == 9
