import datetime as dt
from decimal import Decimal as D

from helpers import one
from jobspectra.sources import pages

PAGE = """<html><body><h1 data-qa="vacancy-title">Senior <b>Frontend</b></h1>
<div data-qa="vacancy-salary"><span>от 300&nbsp;000 до 450&nbsp;000 руб.</span> <span>до вычета налогов</span></div>
<a data-qa="vacancy-company-name" href="/employer/67890"><span>Big &amp; Co</span></a>
<span data-qa="vacancy-experience">От 3 до 6 лет</span>
<p data-qa="work-formats-text">Формат работы:<span>гибрид</span></p>
<div data-qa="vacancy-description"><div>Один<br>два</div><p>три</p></div>
<ul><li data-qa="skills-element"><div class="a-tag__label_1">React</div></li><li data-qa="skills-element">Git</li></ul>
<div><div>Вакансия опубликована <span>3 июня 2026</span> в Москве</div></div></body></html>"""


def test_posting_page(spark):
    df = spark.createDataFrame([(1, "/vacancy/55?x", PAGE), (2, "/vacancy/56", "<h1>other</h1>")], "page_id long, url string, html string")
    got = one(pages.raw_postings(df, 2026, keep_html=True))
    assert (got.posting_id, got.title, got.employer_name, got.employer_id) == (55, "SeniorFrontend", "Big & Co", 67890)
    assert (got.salary_from, got.salary_to, got.salary_currency, got.salary_gross) == (D(300000), D(450000), "RUR", True)
    assert (got.experience_raw, got.employment_format) == ("От 3 до 6 лет", "hybrid")
    assert got.description == "Одиндватри" and got.skills == ["React", "Git"] and got.raw_html == PAGE
    assert got.published_at == dt.datetime(2026, 6, 3)


def test_skills_are_taken_node_by_node(spark):
    node = '<li data-qa="skills-element">%s</li>'
    inner = '<div class="x-tag__label">%s</div>'
    page = '<h1 data-qa="vacancy-title">t</h1>' + node % "Vue" + node % (inner % "React" + inner % "Redux") + node % (inner % "CSS")
    df = spark.createDataFrame([(1, "/vacancy/1", page)], "page_id long, url string, html string")
    assert one(pages.raw_postings(df, 2026, keep_html=False)).skills == ["Vue", "React", "CSS"]


def test_search_page_links(spark):
    html = ('<h1 data-qa="title">Найдено 1 426 вакансий</h1><a class="serp-item__title" href="/vacancy/111?from=x">a</a>'
            '<a class="serp-item__title" href="https://x.example/vacancy/222">b</a><a class="serp-item__title" href="/vacancy/111?dup">c</a>')
    df = spark.createDataFrame([(1, html), (2, '<a data-qa="serp-item__title" href="/vacancy/9">z</a>')], "page_id long, html string")
    got = pages.search_links(df, "https://base.example").orderBy("page_id", "position").collect()
    assert [(r.posting_id, r.url) for r in got] == [(111, "https://base.example/vacancy/111?from=x"),
                                                    (222, "https://x.example/vacancy/222"), (9, "https://base.example/vacancy/9")]
    assert [r.results for r in pages.result_counts(df).orderBy("page_id").collect()] == [1426, 0]


def test_pages_of_one_file_are_read_by_all_cores(spark, tmp_path):
    from jobspectra.plans.catalog.normalization import _posting_pages

    orders = spark.sql("SELECT id AS o_orderkey, id AS o_custkey, 1000.0D AS o_totalprice, timestamp_ntz'2001-01-01' AS o_orderdate FROM range(0, 400, 1, 1)")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = _posting_pages(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r.page_id for r in found.select("page_id").collect()) == list(range(400))
