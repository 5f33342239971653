import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from helpers import one, raw
from jobspectra.functions import fields, html, salary
from jobspectra.functions import timebuckets as tb
from jobspectra.functions import relevance
from jobspectra.functions.relevance import score_postings
from jobspectra.sources import payloads
from jobspectra.sources.terms import default_rows, default_terms, seed


def values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_periods(spark):
    df = values(spark, [(dt.date(2026, 5, 15),)], "d date")
    got = one(df.select(*[tb.period_start(F.col("d"), p).alias(p) for p in ("day", "week", "month", "year")]))
    assert list(got) == [dt.date(2026, 5, 15), dt.date(2026, 5, 11), dt.date(2026, 5, 1), dt.date(2026, 1, 1)]
    ends = values(spark, [(dt.date(2026, 5, 15), dt.date(2026, 5, 11), dt.date(2026, 12, 1), dt.date(2026, 1, 1))],
                  "a date, b date, c date, e date")
    got = one(ends.select(tb.period_end(F.col("a"), "day"), tb.period_end(F.col("b"), "week"),
                          tb.period_end(F.col("c"), "month"), tb.period_end(F.col("e"), "year")))
    assert list(got) == [dt.date(2026, 5, 16), dt.date(2026, 5, 18), dt.date(2027, 1, 1), dt.date(2027, 1, 1)]
    with pytest.raises(ValueError):
        tb.period_start(F.col("d"), "decade")
    assert tb.period_spine(spark, dt.date(2026, 3, 1), dt.date(2026, 5, 31), "month").count() == 3
    assert tb.period_spine(spark, dt.date(2026, 5, 1), dt.date(2026, 3, 1), "month").count() == 0


def test_fixed_offset_has_no_summer_time(spark):
    df = values(spark, [("1996-07-01 21:30:00",), ("1996-07-01 20:59:59",)], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("t"))
    days = [r[0] for r in df.select(tb.local_date(F.col("t"))).collect()]
    assert days == [dt.date(1996, 7, 2), dt.date(1996, 7, 1)]
    kept = df.where(tb.in_date_range(F.col("t"), dt.date(1996, 7, 2), dt.date(1996, 7, 2)))
    assert kept.count() == 1


@pytest.mark.parametrize("low, high, code, gross, want", [
    (80000, 120000, "RUR", False, (80000, 120000, 100000)),
    (300000, None, "RUR", True, (261000, None, 261000)),
    (3000, 5000, "USD", False, (270000, 450000, 360000)),
    (100000, None, "RUR", None, (87000, None, 87000)),
    (None, None, None, None, (None, None, None)),
    (None, 200000, "RUR", False, (None, 200000, 200000)),
    (0, 100, "XYZ", False, (None, 100, 100)),
    (10, None, None, False, (10, None, 10)),
])
def test_salary_rules(spark, low, high, code, gross, want):
    df = raw(spark, {"salary_from": low, "salary_to": high, "salary_currency": code, "salary_gross": gross})
    got = one(salary.with_salary(df))
    assert (got.from_net, got.to_net, got.estimate) == tuple(None if w is None else D(w) for w in want)
    assert (got.currency is None) == (low is None and high is None)


@pytest.mark.parametrize("text, want", [
    ("от 80 000 до 120 000 руб. на руки", (80000, 120000, "RUR", False)),
    ("от 300 000 до 450 000 руб. до вычета налогов", (300000, 450000, "RUR", True)),
    ("от 250 000 руб. на руки", (250000, None, "RUR", False)),
    ("от 3 000 до 5 000 USD на руки", (3000, 5000, "USD", False)),
    ("300 000 руб. до вычета", (None, 300000, "RUR", True)),
    ("1 500 – 2 000 €", (1500, 2000, "EUR", None)),
    ("100 000 – 150 000 ₽", (100000, 150000, "RUR", None)),
    ("", (None, None, None, None)), (None, (None, None, None, None)),
])
def test_salary_text(spark, text, want):
    got = one(values(spark, [(text,)], "t string").select(salary.salary_from_text(F.col("t")).alias("x")).select("x.*"))
    assert tuple(got) == tuple(D(w) if type(w) is int else w for w in want)


@pytest.mark.parametrize("title, experience, want", [
    ("Junior Frontend-разработчик", None, "junior"), ("Senior Frontend Developer", None, "senior"),
    ("Middle Frontend developer React", None, "middle"), ("Frontend developer", "noExperience", "junior"),
    ("Frontend developer", "between3And6", "senior"), ("Frontend developer", None, "unknown"),
    ("Senior Frontend Developer", "noExperience", "senior"), ("Ведущий Frontend-разработчик", None, "senior"),
    ("Frontend разработчик", "Нет опыта", "junior"), ("Подведущийся", None, "unknown"), ("TECH  LEAD", None, "senior"),
])
def test_grades(spark, title, experience, want):
    df = values(spark, [(title, None, experience)], "t string, d string, e string")
    assert one(df.select(fields.grade_code(F.col("t"), F.col("d"), F.col("e"))))[0] == want


def test_skills_keep_first_spelling_order(spark):
    df = values(spark, [(["React", "react", "  React ", "JavaScript", "javascript"],), ([],), (["Vue.js", "TypeScript", "vue.js"],)],
                "s array<string>")
    assert [r[0] for r in df.select(fields.canonical_skills(F.col("s"))).collect()] == [
        ["react", "javascript"], [], ["vue.js", "typescript"]]


@pytest.mark.parametrize("text, want", [
    ("Вакансия опубликована 5 июня 2026 в Москве", dt.datetime(2026, 6, 5)), ("3 мая", dt.datetime(2025, 5, 3)),
    ("31 февраля 2026", None), ("вчера", None), ("", None), ("12 МАРТА 2024", dt.datetime(2024, 3, 12)),
])
def test_russian_dates(spark, text, want):
    df = values(spark, [(text,)], "t string")
    assert one(df.select(fields.russian_date(F.col("t"), F.lit(2025))))[0] == want


def test_formats_ids_and_times(spark):
    df = values(spark, [("Формат работы:удалённо", "/vacancy/12?x", "2026-06-01T12:00:00+0300")], "f string, u string, t string")
    got = one(df.select(fields.work_format(F.col("f")), fields.id_after(F.col("u"), "vacancy"), fields.id_after(F.col("u"), "employer"),
                        fields.iso_timestamp(F.col("t")), fields.iso_timestamp(F.lit("soon")),
                        fields.iso_timestamp(F.lit("2026-06-01T09:00:00Z"))))
    moment = dt.datetime(2026, 6, 1, 9)
    assert list(got) == ["remote", 12, None, moment, None, moment]


CASES = [
    ("Junior Frontend-разработчик (React)", "Ищем frontend-разработчика с знанием React, JavaScript.", ["React"], True),
    ("Senior Frontend Developer (Vue.js / TypeScript)", "Глубокие знания JavaScript, опыт с SPA, Vue.js.", ["Vue.js"], True),
    ("Верстальщик / Frontend developer", "Адаптивная верстка, HTML, CSS, JavaScript.", ["HTML"], True),
    ("Fullstack-разработчик (Node.js + React)", "Backend на Node.js, frontend на React.", ["React"], False),
    ("Backend-разработчик Python (Django)", "REST API, PostgreSQL, Redis.", ["Python"], False),
    ("QA Engineer / Тестировщик", "Тестирование frontend-приложений.", ["Cypress"], False),
    ("DevOps Engineer", "CI/CD, Kubernetes, деплой frontend и backend.", ["Docker"], False),
    ("Системный аналитик", "", ["SQL"], False), ("UI/UX Дизайнер", "", ["Figma"], False),
    ("Project Manager", "Управление frontend-командой, React-проекты.", ["React"], False),
    ("Frontend developer", "", [], True), ("", "", [], True),
]


def by_rule(title, body, hard=True):
    """The decision by a plain loop over the dictionary."""
    score, last_title, first_body = 0.0, None, None
    title, body = title.lower(), body.lower()
    for _, term, kind, scope, weight in default_rows():
        in_title = term in title and scope in ("title", "any")
        in_body = term in body and scope in ("description", "any")
        if kind == "positive":
            score += float(weight) * (3 * in_title + in_body)
            continue
        if in_title and hard:
            return (False, -999.0, "hard_stop_title", term)
        score -= float(weight) * (3 * in_title + in_body)
        last_title = term if in_title else last_title
        first_body = first_body or (term if in_body else None)
    return (True, score, None, None) if score >= 0 else (False, score, "low_score", last_title or first_body)


@pytest.mark.parametrize("hard", [True, False])
def test_relevance_matches_the_plain_rule(spark, hard):
    rows = [{"posting_id": i, "title": t, "description": d, "skills": s} for i, (t, d, s, _) in enumerate(CASES)]
    got = score_postings(raw(spark, *rows), default_terms(spark), hard_stop_on_title=hard).orderBy("posting_id").collect()
    for r, (title, text, skills, relevant) in zip(got, CASES):
        assert (r.relevant, r.score, r.reason, r.matched_stopword) == by_rule(title, f"{text} {' '.join(skills)}", hard)
        if hard:
            assert r.relevant == relevant


@pytest.mark.parametrize("hard", [True, False])
@pytest.mark.parametrize("portion", [1 << 24, 700_000])
def test_relevance_of_a_large_dictionary(spark, monkeypatch, hard, portion):
    """50 000 terms in one portion or several give what a plain loop gives, in a plan of the same size."""
    monkeypatch.setattr(relevance, "PORTION_BYTES", portion)
    kinds, scopes = ("positive", "positive", "stop"), ("title", "description", "any")
    fixed = [("kt", "stop", "any"), ("KT", "positive", "title"), ("", "stop", "any"), ("é–x", "positive", "any")]
    every = [(i, f"t{i:x}", kinds[i % 3], scopes[i % 7 % 3], 0.5 * (i % 4)) for i in range(50000)]
    every += [(60000 + i, t, k, sc, 2.0) for i, (t, k, sc) in enumerate(fixed)]
    terms = spark.createDataFrame(every, "ord int, term string, kind string, field_scope string, weight double").withColumn("active", F.lit(True))
    texts = [("T1F kt", "say tabc and t7 é–X"), ("", ""), (None, None), ("no such", "word"), ("tc34f T2 t1", "kt" * 3000), ("tabc", "t1 t2 t3 t4 t5")]
    rows = [{"posting_id": i, "title": t, "description": d, "skills": None} for i, (t, d) in enumerate(texts)]
    scored = score_postings(raw(spark, *rows), terms, hard_stop_on_title=hard)
    for r, (title, text) in zip(scored.orderBy("posting_id").collect(), texts):
        title, text = (title or "").lower(), (text or "").lower() + " "
        above = [t for t in every if t[1] and t[1].lower() in title and t[3] in ("title", "any")]
        below = [t for t in every if t[1] and t[1].lower() in text and t[3] in ("description", "any")]
        score = sum((1 if t[2] == "positive" else -1) * t[4] * f for part, f in ((above, 3), (below, 1)) for t in part)
        st, sb = ([t[1].lower() for t in part if t[2] == "stop"] for part in (above, below))
        if hard and st:
            want = (False, -999.0, "hard_stop_title", st[0])
        else:
            want = (True, score, None, None) if score >= 0 else (False, score, "low_score", (st[-1:] or sb[:1] or [None])[0])
        assert (r.relevant, r.score, r.reason, r.matched_stopword) == want
    assert len(scored._jdf.queryExecution().toString()) < 40000


def test_seed_adds_only_missing_terms(spark):
    defaults = default_terms(spark)
    once = seed(defaults.limit(0), defaults)
    assert once.count() == defaults.count() == 86
    assert seed(once, defaults).count() == 86


def test_payload(spark):
    text = ('{"id": "7", "name": "Dev", "alternate_url": "u", "employer": {"id": 5, "name": "E"}, '
            '"salary": {"from": 0, "to": 150000, "currency": "RUR", "gross": true}, "experience": {"id": "noExperience"}, '
            '"schedule": {"id": "flexible"}, "key_skills": [{"name": "React"}, {}], "published_at": "2026-06-01T12:00:00+0300", '
            '"area": {"name": "Москва"}}')
    got = one(payloads.raw_postings(values(spark, [(text,)], "payload string")))
    assert (got.posting_id, got.employer_id, got.salary_from, got.salary_to) == (7, 5, None, D(150000))
    assert (got.employment_format, got.skills, got.published_at) == ("hybrid", ["React"], dt.datetime(2026, 6, 1, 9))


def test_blocked_and_counter(spark):
    pages = values(spark, [("<form class='MyCaptcha'>" + "x" * 6000,), ("captcha",), ("captcha" + "x" * 6000,), ("ok",), (None,)], "h string")
    assert [r[0] for r in pages.select(html.is_blocked(F.col("h"))).collect()] == [True, True, False, False, False]
    df = values(spark, [("Найдено 1 426 вакансий",), (None,), ("нет",)], "t string")
    assert [r[0] for r in df.select(html.counter_value(F.col("t"))).collect()] == [1426, 0, 0]
