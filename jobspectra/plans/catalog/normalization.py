"""Normalization, relevance and extraction on rows derived from the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobspectra.functions import fields, html, salary
from jobspectra.functions.relevance import score_postings
from jobspectra.operators import views
from jobspectra.functions.skilldict import ALIASES, resolve_alias
from jobspectra.plans import bindings as b
from jobspectra.plans.ingest import normalize, tag_batch
from jobspectra.schema import SALARY_COLUMNS
from jobspectra.sources import pages, payloads
from jobspectra.sources.terms import default_rows, default_terms

ENTRIES: dict[str, tuple] = {}


def key():
    return F.col("o_orderkey")


def employer():
    return F.col("o_custkey")



def add(name, fn, sql=None):
    ENTRIES[name] = (fn, sql)


# --- salary ---------------------------------------------------------------------------
add("normalize_salary",
    lambda s, d: salary.with_salary(b.raw_postings(s, d)).select("posting_id", *SALARY_COLUMNS),
    f"""WITH {b.SQL_RAW}, {b.sql_normalize('rw')}
    SELECT posting_id, salary_from AS amount_from, salary_to AS amount_to, currency,
    CASE WHEN currency IS NOT NULL THEN salary_gross END AS gross, from_net, to_net, estimate FROM s4""")


def _salary_texts(s, d):
    """Salary phrases with plain, non-breaking and thin spaces inside the numbers."""
    space = F.when(key() % 3 == 0, " ").when(key() % 3 == 1, " ").otherwise(" ")
    amount = lambda plus: F.replace(F.format_number(F.floor("o_totalprice").cast("long") + plus, 0),
                                    F.lit(","), space)
    low, high = amount(0), amount(1000)
    text = (F.when(key() % 6 == 0, F.concat(F.lit("от "), low, F.lit(" до "), high, F.lit(" руб. на руки")))
            .when(key() % 6 == 1, F.concat(F.lit("от "), low, F.lit(" до "), high, F.lit(" ₽ до вычета налогов")))
            .when(key() % 6 == 2, F.concat(F.lit("от "), low, F.lit(" USD")))
            .when(key() % 6 == 3, F.concat(low, F.lit(" руб. до вычета")))
            .when(key() % 6 == 4, F.concat(low, F.lit(" – "), high, F.lit(" € net"))).otherwise(""))
    return b.load(s, d, "orders").select(key().alias("posting_id"), text.alias("text"))


add("salary_text_parse",
    lambda s, d: (_salary_texts(s, d).select("posting_id", salary.salary_from_text(F.col("text")).alias("x"))
                  .select("posting_id", "x.*")),
    """WITH x AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS DECIMAL(14,2)) AS a FROM orders)
    SELECT k AS posting_id, CASE WHEN k % 6 IN (0, 1, 2, 4) THEN a END AS amount_from,
    CASE WHEN k % 6 IN (0, 1, 4) THEN CAST(a + 1000 AS DECIMAL(14,2)) WHEN k % 6 = 3 THEN a END AS amount_to,
    CASE k % 6 WHEN 0 THEN 'RUR' WHEN 1 THEN 'RUR' WHEN 2 THEN 'USD' WHEN 3 THEN 'RUR' WHEN 4 THEN 'EUR' END AS currency,
    CASE k % 6 WHEN 0 THEN false WHEN 1 THEN true WHEN 3 THEN true WHEN 4 THEN false END AS gross FROM x""")

# --- dates, formats, ids --------------------------------------------------------------
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября",
          "ноября", "декабря"]


def _date_texts(s, d):
    day = F.dayofmonth("o_orderdate").cast("string")
    month = b.choose(MONTHS, F.month("o_orderdate") - 1)
    phrase = lambda *parts: F.concat(F.lit("Вакансия опубликована "), *parts)
    text = (F.when(key() % 11 == 0, phrase(F.lit("31 февраля 1999")))
            .when(key() % 4 == 0, phrase(day, F.lit(" "), month))
            .otherwise(phrase(day, F.lit(" "), F.upper(month), F.lit(" "), F.year("o_orderdate").cast("string"),
                              F.lit(" в Москве"))))
    return b.load(s, d, "orders").select(key().alias("posting_id"), text.alias("text"))


add("ru_date_parse",
    lambda s, d: _date_texts(s, d).select("posting_id",
                                          fields.russian_date(F.col("text"), F.lit(2001)).alias("published_at")),
    """SELECT o_orderkey AS posting_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 4 = 0
    THEN CAST(try_cast(printf('2001-%02d-%02d', month(o_orderdate), day(o_orderdate)) AS DATE) AS TIMESTAMP)
    ELSE o_orderdate END AS published_at FROM orders""")

FORMAT_TEXTS = {"Формат работы:удалённо": "remote", "Формат работы: гибрид": "hybrid", "Офис": "office",
                "На месте работодателя": "office", "Remote": "remote", "": "unknown", "вахта": "unknown",
                "Формат работы: на месте или гибрид": "hybrid"}
SCHEDULES = {"remote": "remote", "fullDay": "office", "flexible": "hybrid", "shift": "office",
             "flyInFlyOut": "office", "other": "unknown", "": "unknown"}
add("work_format",
    lambda s, d: (b.load(s, d, "orders").select(
        key().alias("posting_id"), fields.work_format(b.choose(list(FORMAT_TEXTS), key())).alias("employment_format"),
        fields.schedule_format(b.choose(list(SCHEDULES), employer())).alias("schedule_format"))),
    f"""SELECT o_orderkey AS posting_id, {b.sql_choose(list(FORMAT_TEXTS.values()), 'o_orderkey')} AS employment_format,
    {b.sql_choose(list(SCHEDULES.values()), 'o_custkey')} AS schedule_format FROM orders""")
add("url_ids",
    lambda s, d: b.load(s, d, "pages").select(
        "page_id", fields.id_after(F.col("url"), "[a-z]{2}").alias("item_id"),
        fields.id_after(F.col("url"), "vacancy").alias("vacancy_id")),
    r"""SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '/[a-z]{2}/(\d+)', 1), '') AS BIGINT) AS item_id,
    TRY_CAST(nullif(regexp_extract(url, '/vacancy/(\d+)', 1), '') AS BIGINT) AS vacancy_id FROM pages""")

# --- grades, skills, relevance --------------------------------------------------------
_words = {g: "|".join(w) for g, w in fields.GRADE_KEYWORDS.items()}


def sql_keyword_grade(text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({text}), '{b.sql_bounded(_words[g])}') THEN '{g}'"
                              for g in ("senior", "middle", "junior")) + " END"


SQL_EXPERIENCE = ("CASE " + " ".join(f"WHEN contains(replace(replace(lower(experience_raw), ' ', ''), '-', ''), '{k}') THEN '{v}'"
                                     for k, v in fields.EXPERIENCE_CODES.items())
                  + " " + " ".join(f"WHEN contains(lower(experience_raw), '{k}') THEN '{v}'"
                                   for k, v in fields.EXPERIENCE_PHRASES.items()) + " END")
SQL_GRADE = f"coalesce({sql_keyword_grade('title')}, {sql_keyword_grade('description')}, {SQL_EXPERIENCE}, 'unknown')"
add("grade_resolution",
    lambda s, d: b.raw_postings(s, d).select(
        "posting_id", fields.grade_code(F.col("title"), F.col("description"), F.col("experience_raw")).alias("grade_code")),
    f"WITH {b.SQL_RAW} SELECT posting_id, {SQL_GRADE} AS grade_code FROM rw")
add("grade_documents",
    lambda s, d: b.load(s, d, "documents").select("doc_id", fields.keyword_grade(F.col("text")).alias("grade_code")),
    f"SELECT doc_id, {sql_keyword_grade('text')} AS grade_code FROM documents")
CANONICAL = b.SQL_CANONICAL.format("skills")
add("canonical_skills",
    lambda s, d: b.raw_postings(s, d).select(
        "posting_id", F.array_join(fields.canonical_skills(F.col("skills")), "|").alias("skills")),
    f"""WITH {b.SQL_RAW}, c AS (SELECT posting_id, {CANONICAL} AS l FROM rw)
    SELECT posting_id, array_to_string({b.sql_distinct_in_order('l')}, '|') AS skills FROM c""")
add("alias_resolution",
    lambda s, d: (views.resolve_aliases(b.load(s, d, "part").select(
        "p_partkey", F.array(b.choose(list(ALIASES), F.col("p_partkey")), F.col("p_name"),
                             F.upper(b.choose(list(ALIASES), F.col("p_partkey")))).alias("skills")))
        .select("p_partkey", F.array_join("skills", "|").alias("skills"))),
    f"""SELECT p_partkey, {b.sql_choose(list(ALIASES.values()), 'p_partkey')} || '|' || trim(p_name) AS skills FROM part""")

SQL_TERMS = "t(ord, term, kind, scope, weight) AS (VALUES " + ", ".join(
    f"({o}, '{t}', '{k}', '{sc}', {w}::DOUBLE)" for o, t, k, sc, w in default_rows()) + ")"


def sql_score(source: str, key: str) -> str:
    """CTE ``sc``: the relevance decision for a relation with key, title, body."""
    return f"""{SQL_TERMS},
    h AS (SELECT r.{key}, ord, term, kind, weight,
      contains(lower(title), term) AND scope IN ('title', 'any') AS in_title,
      contains(lower(body), term) AND scope IN ('description', 'any') AS in_body FROM {source} r CROSS JOIN t),
    g AS (SELECT {key}, sum(CASE WHEN kind = 'positive' THEN weight * (3.0 * in_title::INT + in_body::INT)
        ELSE -weight * (3.0 * in_title::INT + in_body::INT) END) AS total,
      arg_min(term, ord) FILTER (kind = 'stop' AND in_title) AS first_title,
      arg_min(term, ord) FILTER (kind = 'stop' AND in_body) AS first_body FROM h GROUP BY 1),
    sc AS (SELECT {key}, first_title IS NULL AND total >= 0 AS relevant,
      CASE WHEN first_title IS NOT NULL THEN -999.0::DOUBLE ELSE CAST(total AS DOUBLE) END AS score,
      CASE WHEN first_title IS NOT NULL THEN 'hard_stop_title' WHEN total < 0 THEN 'low_score' END AS reason,
      CASE WHEN first_title IS NOT NULL THEN first_title WHEN total < 0 THEN first_body END AS matched_stopword FROM g)"""


SQL_SCORED = f"""{b.SQL_RAW}, rb AS (SELECT posting_id, title,
  description || ' ' || array_to_string(skills, ' ') AS body FROM rw), {sql_score('rb', 'posting_id')}"""
add("relevance_score",
    lambda s, d: score_postings(b.raw_postings(s, d), default_terms(s)).select(
        "posting_id", "relevant", "score", "reason", "matched_stopword"),
    f"WITH {SQL_SCORED} SELECT * FROM sc")
add("relevance_documents",
    lambda s, d: score_postings(b.load(s, d, "documents").select(
        "doc_id", F.split("text", "\n")[0].alias("title"), F.col("text").alias("description"),
        F.array(F.col("source")).alias("skills")), default_terms(s)).select(
        "doc_id", "relevant", "score", "reason", "matched_stopword"),
    f"""WITH rb AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text || ' ' || source AS body FROM documents),
    {sql_score('rb', 'doc_id')} SELECT * FROM sc""")
add("relevance_rejects",
    lambda s, d: (tag_batch(b.raw_postings(s, d), default_terms(s)).where("outcome = 'filtered'")
                  .groupBy("reason", "matched_stopword").agg(F.count("*").alias("count"))),
    f"""WITH {SQL_SCORED} SELECT reason, matched_stopword, count(*) AS "count" FROM sc WHERE NOT relevant GROUP BY 1, 2""")


def benchmark_terms(s, d):
    """A dictionary of thousands of terms: all word pairs of the benchmark texts."""
    words = b.load(s, d, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    pairs = words.select(F.explode(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"),
                                                F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("p"))
    size = F.length("term")
    return pairs.select(F.concat_ws(" ", "p.a", "p.b").alias("term")).where("p.b is not null").distinct().select(
        F.lit(0).alias("ord"), "term", F.when(size % 11 == 7, "stop").otherwise("positive").alias("kind"),
        F.when(size % 5 == 0, "title").when(size % 5 == 1, "description").otherwise("any").alias("field_scope"),
        (F.lit(0.5) * (1 + size % 3)).alias("weight"), F.lit(True).alias("active"))


add("relevance_large_dictionary",
    lambda s, d: score_postings(b.load(s, d, "documents").select(
        "doc_id", F.split("text", "\n")[0].alias("title"), F.col("text").alias("description"),
        F.array(F.col("source")).alias("skills")), benchmark_terms(s, d), hard_stop_on_title=False).select(
        "doc_id", "relevant", "score", "reason", "matched_stopword"),
    """WITH rb AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS title, lower(text || ' ' || source) AS body FROM documents),
    ws AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
    pr AS (SELECT DISTINCT term FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM ws)),
    t AS (SELECT term, CASE WHEN length(term) % 11 = 7 THEN -1 ELSE 1 END AS sign, length(term) % 5 AS place, 0.5::DOUBLE * (1 + length(term) % 3) AS weight FROM pr),
    h AS (SELECT doc_id, term, sign, weight, place <> 1 AND contains(title, term) AS in_title, place <> 0 AND contains(body, term) AS in_body
      FROM rb JOIN t ON contains(body, term)),
    g AS (SELECT doc_id, sum(sign * weight * (3.0::DOUBLE * in_title::INT + in_body::INT)) AS total,
      max(term) FILTER (sign < 0 AND in_title) AS last_title, min(term) FILTER (sign < 0 AND in_body) AS first_body FROM h GROUP BY 1),
    f AS (SELECT doc_id, coalesce(total, 0::DOUBLE) AS score, coalesce(last_title, first_body) AS stop FROM rb LEFT JOIN g USING (doc_id))
    SELECT doc_id, score >= 0 AS relevant, score, CASE WHEN score < 0 THEN 'low_score' END AS reason, CASE WHEN score < 0 THEN stop END AS matched_stopword FROM f""")
STAMP = "TIMESTAMP '2001-09-01 00:00:00'"
SQL_NORMALIZED = f"""{SQL_SCORED}, {b.sql_normalize('rw')},
  nz AS (SELECT s4.posting_id, title, employer_id, {SQL_GRADE} AS grade_code, employment_format, published_at, estimate,
         {CANONICAL} AS l, skills, employer_name, url FROM s4 JOIN sc USING (posting_id) WHERE relevant)"""


def _normalized(s, d):
    tagged = tag_batch(b.raw_postings(s, d), default_terms(s)).where("outcome = 'accepted'")
    stamp = F.expr("TIMESTAMP_NTZ'2001-09-01 00:00:00'")
    return normalize(tagged, stamp).select("posting_id", "title", "employer_id", "grade_code", "employment_format",
                                           "published_at", "estimate", F.array_join("skills", "|").alias("skills"))


add("normalize_postings", _normalized,
    f"""WITH {SQL_NORMALIZED} SELECT posting_id, title, employer_id, grade_code, employment_format, published_at,
    estimate, array_to_string({b.sql_distinct_in_order('l')}, '|') AS skills FROM nz""")

# --- JSON payloads --------------------------------------------------------------------


def _payloads(s, d):
    """Payload texts; the instant is written with three kinds of offsets and one bad form."""
    at = lambda hours, fmt: F.date_format(F.col("o_orderdate") + F.expr(f"INTERVAL '{hours}' HOUR"), fmt)
    published = (F.when(key() % 4 == 0, F.concat(at(0, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
                 .when(key() % 4 == 1, F.concat(at(3, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0300")))
                 .when(key() % 4 == 2, F.concat(at(-5, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00"))).otherwise("soon"))
    bound = lambda e: F.coalesce(F.expr(b.RAW_SALARY[e]), F.lit(0).cast("decimal(14,2)"))
    pay = F.struct(bound("salary_from").alias("from"), bound("salary_to").alias("to"),
                   F.expr(b.RAW_SALARY["salary_currency"]).alias("currency"),
                   F.expr(b.RAW_SALARY["salary_gross"]).alias("gross"))
    body = F.struct(
        key().cast("string").alias("id"), b.choose(b.TITLES, key() + employer()).alias("name"),
        F.concat(F.lit("https://jobs.example.com/vacancy/"), key()).alias("alternate_url"),
        F.when(key() % 5 != 0, pay).alias("salary"),
        F.struct(employer().cast("string").alias("id"), F.concat(F.lit("Employer "), employer()).alias("name")).alias("employer"),
        F.struct(b.choose(b.EXPERIENCES, key()).alias("id")).alias("experience"),
        F.struct(b.choose(list(SCHEDULES), key()).alias("id")).alias("schedule"),
        F.transform(F.array(b.choose(b.SKILLS_RAW, key()), F.lit("Git")), lambda x: F.struct(x.alias("name"))).alias("key_skills"),
        published.alias("published_at"), F.struct(F.lit("Москва").alias("name")).alias("area"))
    return b.load(s, d, "orders").select(F.to_json(body).alias("payload"))


add("payload_parse",
    lambda s, d: payloads.raw_postings(_payloads(s, d)).select(
        "posting_id", "title", "employer_id", "employer_name", "salary_from", "salary_to", "salary_currency",
        "salary_gross", "experience_raw", "employment_format", "area_name", "published_at",
        F.array_join("skills", "|").alias("skills")),
    f"""WITH {b.SQL_RAW} SELECT o.o_orderkey AS posting_id, title, employer_id, employer_name, salary_from, salary_to,
    CASE WHEN o.o_orderkey % 5 <> 0 THEN salary_currency END AS salary_currency,
    CASE WHEN o.o_orderkey % 5 <> 0 THEN salary_gross END AS salary_gross,
    {b.sql_choose(b.EXPERIENCES, 'o.o_orderkey')} AS experience_raw,
    {b.sql_choose(list(SCHEDULES.values()), 'o.o_orderkey')} AS employment_format, 'Москва' AS area_name,
    CASE WHEN o.o_orderkey % 4 <> 3 THEN o.o_orderdate END AS published_at,
    {b.sql_choose(b.SKILLS_RAW, 'o.o_orderkey')} || '|Git' AS skills FROM orders o JOIN rw ON rw.posting_id = o.o_orderkey""")

# --- pages ----------------------------------------------------------------------------
_DECODE = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
add("page_fields",
    lambda s, d: b.load(s, d, "pages").select(
        "page_id", html.tag_text(F.col("html"), "h1").alias("title"), F.size(html.links(F.col("html"))).alias("links")),
    f"""SELECT page_id, nullif(trim({_DECODE.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}), '') AS title,
    CAST(len(regexp_extract_all(html, '(?is)<a [^>]*>')) AS INTEGER) AS links FROM pages""")
add("page_links",
    lambda s, d: b.load(s, d, "pages").select("page_id", F.posexplode(html.links(F.col("html"))).alias("position", "href")),
    """WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a [^>]*href="([^"]*)"', 1) AS l FROM pages)
    SELECT page_id, CAST(unnest(range(len(l))) AS INTEGER) AS position, unnest(l) AS href FROM l""")


def _search_pages(s, d):
    """Each order as a search page: relative, absolute and repeated links, and a counter."""
    link = lambda attr, href: F.concat(F.lit(f'<div><a {attr} href="'), *href, F.lit('">x</a></div>'))
    main, other = 'class="bloc serp-item__title"', 'data-qa="serp-item__title"'
    base = F.lit("https://other.example.com/vacancy/")
    anchors = lambda attr: F.concat(
        link(attr, [F.lit("/vacancy/"), key(), F.lit("?from=x")]), link(attr, [base, key() + 1]),
        link(attr, [F.lit("/vacancy/"), key(), F.lit("?dup")]), link(attr, [F.lit("/help")]))
    body = F.when(key() % 2 == 0, F.concat(anchors(main), link(other, [F.lit("/vacancy/999")]))).otherwise(anchors(other))
    number = F.replace(F.format_number(employer() * 1000 + 7, 0), F.lit(","), F.lit(" "))
    counter = (F.when(key() % 3 == 0, F.concat(F.lit('<h1 data-qa="title">Найдено '), number, F.lit(" вакансий</h1>")))
               .when(key() % 3 == 1, F.concat(F.lit('<div data-qa="vacancies-search-header"><div><h1><span>'), number,
                                            F.lit("</span> вакансий</h1></div></div>"))).otherwise(""))
    return b.load(s, d, "orders").select(key().alias("page_id"), F.concat(counter, body).alias("html"))


add("search_links",
    lambda s, d: pages.search_links(_search_pages(s, d), "https://jobs.example.com"),
    """SELECT o_orderkey AS page_id, 0 AS position, o_orderkey AS posting_id,
    'https://jobs.example.com/vacancy/' || o_orderkey || '?from=x' AS url FROM orders
    UNION ALL SELECT o_orderkey, 1, o_orderkey + 1, 'https://other.example.com/vacancy/' || (o_orderkey + 1) FROM orders""")
add("result_counts", lambda s, d: pages.result_counts(_search_pages(s, d)),
    """SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 3 < 2 THEN o_custkey * 1000 + 7 ELSE 0 END AS results FROM orders""")


def suspect_pages(s, d):
    page = F.col("page_id")
    tail = (F.when(page % 5 == 0, '<form class="SomeCaptchaForm big">').when(page % 5 == 1, "<p>Captcha</p>")
            .when(page % 5 == 2, '<img src="a.png" class="captcha-picture">').otherwise(""))
    return b.load(s, d, "pages").select("page_id", "url", F.concat("html", tail).alias("html"))


SQL_BLOCKED = "SELECT page_id, page_id % 5 IN (0, 2) OR (page_id % 5 = 1 AND length(html) + 14 < 5000) AS blocked FROM pages"
add("blocked_pages",
    lambda s, d: suspect_pages(s, d).select("page_id", html.is_blocked(F.col("html")).alias("blocked")),
    SQL_BLOCKED)

ARTICLE_RULES = [html.Rule("title", "h1"), html.Rule("description", "article"), html.Rule("skill", "a")]
add("page_texts",
    lambda s, d: pages.page_texts(b.load(s, d, "pages"), ARTICLE_RULES, None).select(
        "page_id", "title", F.length("description").cast("long").alias("length"), F.md5(F.col("description").cast("binary")).alias("digest"),
        F.array_join("skill", "|").alias("anchors")),
    f"""WITH x AS (SELECT page_id, html, regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1),
      '(?is)<(script|style)[^>]*>.*?</(script|style)>', '<x>', 'g') AS inner_html FROM pages),
    y AS (SELECT page_id, html, array_to_string(list_transform(regexp_split_to_array(inner_html, '(?s)<!--.*?-->|<[^>]*>'),
      lambda p: trim({_DECODE.format('p')}, E' \\n\\r\\t')), '') AS body FROM x)
    SELECT page_id, trim({_DECODE.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}) AS title,
    length(body) AS length, md5(body) AS digest,
    array_to_string(list_transform(regexp_extract_all(html, '(?is)<a [^>]*>(.*?)</a>', 1), lambda p: trim({_DECODE.format('p')})), '|')
    AS anchors FROM y""")


def _posting_pages(s, d):
    """Full posting pages written from the orders, with nested and repeated markup."""
    day = F.dayofmonth("o_orderdate").cast("string")
    month = b.choose(MONTHS, F.month("o_orderdate") - 1)
    amount = F.replace(F.format_number(F.floor("o_totalprice").cast("long"), 0), F.lit(","), F.lit(" "))
    wrap = lambda a, x, z: F.concat(F.lit(a), x, F.lit(z))
    page = F.concat(
        F.lit("<html><head><title>x</title><script>var a='<h1>';</script></head><body>"),
        wrap('<h1 data-qa="vacancy-title"> <span>', F.when(key() % 13 == 0, "").otherwise(b.choose(b.TITLES, key())), "</span></h1>"),
        wrap('<div data-qa="vacancy-salary"><span>от ', amount, " руб.</span><span> на руки</span></div>"),
        wrap('<a data-qa="vacancy-company-name" href="/employer/', employer().cast("string"), '?x=1">'),
        F.concat(F.lit("Employer &amp; "), employer().cast("string"), F.lit("</a>")),
        wrap('<p data-qa="vacancy-experience">', b.choose(b.EXPERIENCES, key()), "</p>"),
        wrap('<p data-qa="work-formats-text">', b.choose(list(FORMAT_TEXTS), key()), "</p>"),
        wrap('<div data-qa="vacancy-description"><div><p>', b.choose(b.DESCRIPTIONS, employer()), "</p><br><ul><li>a</li></ul></div>b</div>"),
        F.lit('<li data-qa="skills-element"><div class="x-tag__label-1">React</div></li>'),
        F.lit('<li data-qa="skills-element">Git</li>'),
        F.concat(F.lit("<div>Вакансия опубликована <span>"), day, F.lit(" "), month, F.lit(" "),
                 F.year("o_orderdate").cast("string"), F.lit("</span> в Москве</div></body></html>")))
    url = F.concat(F.lit("https://jobs.example.com/vacancy/"), key(), F.lit("?q=1"))
    # Dealt out before the pages are written, while the rows are narrow.
    orders = b.spread(b.load(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))
    return orders.select(key().alias("page_id"), url.alias("url"), page.alias("html"))


add("html_postings",
    lambda s, d: pages.raw_postings(_posting_pages(s, d), 2001).select(
        "posting_id", "title", "employer_name", "employer_id", "salary_from", "salary_to", "salary_currency",
        "salary_gross", "experience_raw", "employment_format", "published_at", "description",
        F.array_join("skills", "|").alias("skills")),
    f"""SELECT o_orderkey AS posting_id, {b.sql_choose(b.TITLES, 'o_orderkey')} AS title,
    'Employer & ' || o_custkey AS employer_name, o_custkey AS employer_id,
    CAST(floor(o_totalprice) AS DECIMAL(14,2)) AS salary_from, CAST(NULL AS DECIMAL(14,2)) AS salary_to, 'RUR' AS salary_currency,
    false AS salary_gross, {b.sql_choose(b.EXPERIENCES, 'o_orderkey')} AS experience_raw,
    {b.sql_choose(list(FORMAT_TEXTS.values()), 'o_orderkey')} AS employment_format, o_orderdate AS published_at,
    {b.sql_choose(b.DESCRIPTIONS, 'o_custkey')} || 'ab' AS description, 'React|Git' AS skills FROM orders WHERE o_orderkey % 13 <> 0""")
