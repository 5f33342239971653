"""Metrics, series, premiums, views and snapshots on the bound tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from jobspectra.functions import timebuckets as tb
from jobspectra.operators import metrics as m
from jobspectra.operators import premiums, snapshots, views
from jobspectra.plans.bindings import SQL_POSTINGS, employers, load, postings
from jobspectra.session import shared_dir

ENTRIES: dict[str, tuple] = {}
WITH = f"WITH {SQL_POSTINGS}"
SHARE = "round(CAST({0} AS DOUBLE) / {1}, 4)"
STATS = """
  count(estimate) AS "count", count(*) AS total_count,
  round(quantile_cont(CAST(estimate AS DOUBLE), 0.5), 4) AS median,
  CAST(min(estimate) AS DOUBLE) AS "min", CAST(max(estimate) AS DOUBLE) AS "max",
  round(CAST(sum(estimate) AS DOUBLE) / nullif(count(estimate), 0), 6) AS mean,
  round(quantile_cont(CAST(estimate AS DOUBLE), 0.1), 4) AS p10,
  round(quantile_cont(CAST(estimate AS DOUBLE), 0.25), 4) AS p25,
  round(quantile_cont(CAST(estimate AS DOUBLE), 0.5), 4) AS p50,
  round(quantile_cont(CAST(estimate AS DOUBLE), 0.75), 4) AS p75,
  round(quantile_cont(CAST(estimate AS DOUBLE), 0.9), 4) AS p90,
  round(CAST(sum(from_net) AS DOUBLE) / nullif(count(from_net), 0), 6) AS range_from,
  round(CAST(sum(to_net) AS DOUBLE) / nullif(count(to_net), 0), 6) AS range_to,
  round(CAST(count(estimate) AS DOUBLE) / nullif(count(*), 0), 4) AS disclosure_rate,
  count(estimate) < 30 AS low_confidence"""
TRUNC = {"day": "local_day", "week": "CAST(date_trunc('week', local_day) AS DATE)",
         "month": "CAST(date_trunc('month', local_day) AS DATE)",
         "year": "CAST(date_trunc('year', local_day) AS DATE)"}


def add(name, fn, sql=None):
    ENTRIES[name] = (fn, sql)


# --- salaries -------------------------------------------------------------------------
add("salary_summary",
    lambda s, d: m.salary_summary(postings(s, d), digits=4, mean_digits=6),
    f"{WITH} SELECT {STATS} FROM p")
add("salary_summary_by_grade",
    lambda s, d: m.salary_summary(postings(s, d), by=["grade_id"], digits=4, mean_digits=6),
    f"{WITH} SELECT grade_id, {STATS} FROM p GROUP BY grade_id")

RANGE = m.Slice(dt.date(1996, 3, 15), dt.date(1998, 10, 31), "senior")
add("salary_summary_date_range",
    lambda s, d: m.salary_summary(postings(s, d), RANGE, digits=4, mean_digits=6),
    f"{WITH} SELECT {STATS} FROM p WHERE local_day BETWEEN DATE '1996-03-15' AND DATE '1998-10-31' AND grade_id = 3")
add("salary_summary_empty_slice",
    lambda s, d: m.salary_summary(postings(s, d), m.Slice(dt.date(1970, 1, 1), dt.date(1970, 1, 2)),
                                  digits=4, mean_digits=6),
    f"{WITH} SELECT {STATS} FROM p WHERE local_day BETWEEN DATE '1970-01-01' AND DATE '1970-01-02'")

for period in ("day", "week", "month", "year"):
    add(f"salary_timeseries_{period}",
        lambda s, d, period=period: m.salary_series(postings(s, d), period, digits=4),
        f"""{WITH} SELECT {TRUNC[period]} AS period_start,
        round(quantile_cont(CAST(estimate AS DOUBLE), 0.5), 4) AS median,
        round(quantile_cont(CAST(estimate AS DOUBLE), 0.25), 4) AS p25,
        round(quantile_cont(CAST(estimate AS DOUBLE), 0.75), 4) AS p75, count(*) AS "count"
        FROM p WHERE estimate IS NOT NULL GROUP BY 1""")

# --- demand ---------------------------------------------------------------------------
for period in ("day", "week", "month", "year"):
    add(f"demand_{period}",
        lambda s, d, period=period: m.demand_series(postings(s, d), period),
        f"""{WITH}, c AS (SELECT {TRUNC[period]} AS period_start, count(*) AS n FROM p GROUP BY 1)
        SELECT period_start, n AS "count",
        round(CAST(n - lag(n) OVER (ORDER BY period_start) AS DOUBLE) / lag(n) OVER (ORDER BY period_start), 4) AS growth
        FROM c""")

EVENTS = "WITH p AS (SELECT *, CAST(ts + INTERVAL 3 HOUR AS DATE) AS local_day FROM events)"
add("demand_day_offset",
    lambda s, d: m.demand_series(load(s, d, "events").withColumnRenamed("ts", "published_at"), "day"),
    f"""{EVENTS}, c AS (SELECT local_day AS period_start, count(*) AS n FROM p GROUP BY 1)
    SELECT period_start, n AS "count",
    round(CAST(n - lag(n) OVER (ORDER BY period_start) AS DOUBLE) / lag(n) OVER (ORDER BY period_start), 4) AS growth FROM c""")
add("date_range_filter",
    lambda s, d: (load(s, d, "events")
                  .where(tb.in_date_range(F.col("ts"), dt.date(2024, 1, 5), dt.date(2024, 1, 20)))
                  .groupBy(tb.local_date(F.col("ts")).alias("local_day"), "event_type")
                  .agg(F.count("*").alias("count"))),
    f"""{EVENTS} SELECT local_day, event_type, count(*) AS "count" FROM p
    WHERE local_day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1, 2""")
FILLED = """, ends AS (SELECT min(local_day) AS a, max(local_day) AS b FROM p),
  g AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE)
        AS period_start FROM ends),
  c AS (SELECT period_start, count(local_day) AS n FROM g LEFT JOIN p ON local_day = period_start GROUP BY 1)"""
add("demand_day_filled",
    lambda s, d: m.demand_series(postings(s, d), "day", fill_gaps=True),
    f"""{WITH} {FILLED} SELECT period_start, n AS "count", CASE WHEN lag(n) OVER w > 0 THEN
    round(CAST(n - lag(n) OVER w AS DOUBLE) / lag(n) OVER w, 4) END AS growth FROM c WINDOW w AS (ORDER BY period_start)""")
add("demand_ma7",
    lambda s, d: m.demand_moving_average(postings(s, d), "day", 7),
    f"""{WITH} {FILLED} SELECT period_start, n AS "count", round(CAST(sum(n) OVER w AS DOUBLE) / count(*) OVER w, 4)
    AS moving_average FROM c WINDOW w AS (ORDER BY period_start ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
add("period_spine",
    lambda s, d: (m.date_span(postings(s, d))
                  .select(F.explode(tb.period_sequence(F.col("first_day"), F.col("last_day"), "week")).alias("period_start"))
                  .select("period_start", tb.period_end(F.col("period_start"), "week").alias("period_end"))),
    f"""{WITH}, e AS (SELECT date_trunc('week', min(local_day)) AS a, max(local_day) AS b FROM p)
    SELECT CAST(x AS DATE) AS period_start, CAST(x + INTERVAL 7 DAY AS DATE) AS period_end
    FROM (SELECT unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 7 DAY)) AS x FROM e)""")


def _bounds(s, d):
    day = F.col("day")
    days = postings(s, d).select(tb.local_date(F.col("published_at")).alias("day"))
    columns = []
    for p in ("day", "week", "month", "year"):
        start = tb.period_start(day, p)
        columns += [start.alias(f"{p}_start"), tb.period_end(start, p).alias(f"{p}_end")]
    return days.select("day", *columns).groupBy("day", *[f"{p}_{e}" for p in ("day", "week", "month", "year")
                                                           for e in ("start", "end")]).agg(F.count("*").alias("count"))


add("period_bounds", _bounds,
    f"""{WITH} SELECT local_day AS "day", local_day AS day_start, CAST(local_day + INTERVAL 1 DAY AS DATE) AS day_end,
    {TRUNC['week']} AS week_start, CAST({TRUNC['week']} + INTERVAL 7 DAY AS DATE) AS week_end,
    {TRUNC['month']} AS month_start, CAST({TRUNC['month']} + INTERVAL 1 MONTH AS DATE) AS month_end,
    {TRUNC['year']} AS year_start, CAST({TRUNC['year']} + INTERVAL 1 YEAR AS DATE) AS year_end,
    count(*) AS "count" FROM p GROUP BY local_day""")
add("date_span", lambda s, d: m.date_span(postings(s, d)),
    f"{WITH} SELECT min(local_day) AS first_day, max(local_day) AS last_day FROM p")

# --- skills ---------------------------------------------------------------------------
add("skills_top", lambda s, d: m.top_skills(postings(s, d, "p_brand")),
    f"""{WITH}, t AS (SELECT count(*) AS n FROM p)
    SELECT skill, count(*) AS "count", {SHARE.format('count(*)', 'any_value(n)')} AS share,
    any_value(n) AS sample_size, any_value(n) < 30 AS low_confidence
    FROM ps, t GROUP BY skill ORDER BY "count" DESC, skill LIMIT 20""")
add("skills_top_by_grade", lambda s, d: m.top_skills_by(postings(s, d, "p_brand"), "grade_id", n=10),
    f"""{WITH}, t AS (SELECT grade_id, count(*) AS n FROM p GROUP BY 1),
    c AS (SELECT grade_id, skill, count(*) AS c FROM ps GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY grade_id ORDER BY c DESC, skill) AS INTEGER) AS rank FROM c)
    SELECT r.grade_id, rank, skill, c AS "count", {SHARE.format('c', 'n')} AS share, n AS sample_size,
    n < 30 AS low_confidence FROM r JOIN t ON r.grade_id IS NOT DISTINCT FROM t.grade_id WHERE rank <= 10""")
add("skill_cooccurrence", lambda s, d: m.skill_pairs(postings(s, d, "p_brand")),
    f"""{WITH}, t AS (SELECT count(*) AS n FROM p),
    c AS (SELECT x.skill AS a, y.skill AS b, count(*) AS c FROM ps x JOIN ps y
          ON x.posting_id = y.posting_id AND x.skill < y.skill GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (ORDER BY c DESC, a, b) AS INTEGER) AS rank FROM c)
    SELECT rank, a, b, c AS "count", {SHARE.format('c', 'n')} AS share, n AS sample_size, n < 30 AS low_confidence
    FROM r, t WHERE rank <= 20""")
# Every second posting number is a skill of its own, so rare skills are as many as postings.
_TAIL = "concat('Tail ', {0})"
add("skill_cooccurrence_long_tail",
    lambda s, d: m.skill_pairs(postings(s, d, "p_brand").withColumn("skills", F.concat("skills", F.array(F.expr(_TAIL.format("posting_id div 2"))))),
                               n=10, by=["grade_id"]),
    f"""{WITH}, t AS (SELECT grade_id, count(*) AS n FROM p WHERE grade_id IS NOT NULL GROUP BY 1),
    k AS (SELECT posting_id, skill FROM sk UNION SELECT posting_id, {_TAIL.format('posting_id // 2')} FROM p),
    c AS (SELECT grade_id, x.skill AS a, y.skill AS b, count(*) AS c FROM p JOIN k x USING (posting_id) JOIN k y
          ON x.posting_id = y.posting_id AND x.skill < y.skill WHERE grade_id IS NOT NULL GROUP BY 1, 2, 3),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY grade_id ORDER BY c DESC, a, b) AS INTEGER) AS rank FROM c)
    SELECT grade_id, rank, a, b, c AS "count", {SHARE.format('c', 'n')} AS share, n AS sample_size, n < 30 AS low_confidence
    FROM r JOIN t USING (grade_id) WHERE rank <= 10""")
def _sql_delta(period):
    return f"""{WITH}, t AS (SELECT {TRUNC[period]} AS y, count(*) AS n FROM p GROUP BY 1),
    e AS (SELECT min(y) AS a, max(y) AS b FROM t),
    k AS (SELECT skill, {TRUNC[period]} AS y, count(*) AS c FROM ps GROUP BY 1, 2),
    z AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 {period})) AS DATE) AS y FROM e),
    g AS (SELECT s.skill, z.y, t.n, coalesce(k.c, 0) AS c FROM (SELECT DISTINCT skill FROM k) s CROSS JOIN z
          LEFT JOIN t ON t.y = z.y LEFT JOIN k ON k.skill = s.skill AND k.y = z.y),
    h AS (SELECT skill, y, c, coalesce({SHARE.format('c', 'n')}, 0) AS share FROM g),
    d AS (SELECT skill, y AS period_start, c AS "count", share, c - lag(c) OVER w AS count_delta,
      round(share - lag(share) OVER w, 4) AS share_delta FROM h WINDOW w AS (PARTITION BY skill ORDER BY y))"""


for period in ("year", "day"):
    add("skill_delta" if period == "year" else f"skill_delta_{period}",
        lambda s, d, period=period: m.skill_delta(postings(s, d, "p_brand"), period), f"{_sql_delta(period)} SELECT * FROM d")
add("skill_changes", lambda s, d: m.skill_changes(postings(s, d, "p_brand"), "day").drop("covers_from", "covers_to"),
    f"""{_sql_delta('day')} SELECT * FROM d WHERE "count" > 0 OR count_delta < 0""")
add("skills_dictionary", lambda s, d: views.skill_dictionary(postings(s, d, "p_name")),
    f"""SELECT p_name AS skill, count(DISTINCT l_orderkey) AS postings FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")

# --- employers ------------------------------------------------------------------------
add("employers_top",
    lambda s, d: m.top_employers(postings(s, d), employers(s, d)),
    f"""{WITH}, t AS (SELECT count(*) AS n FROM p),
    c AS (SELECT employer_id, c_name AS name, count(*) AS c FROM p JOIN customer ON c_custkey = employer_id GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (ORDER BY c DESC, employer_id) AS INTEGER) AS rank FROM c),
    h AS (SELECT sum(c) AS head FROM r WHERE rank <= 10)
    SELECT rank, employer_id, name, c AS "count", {SHARE.format('c', 'n')} AS share,
    {SHARE.format('head', 'n')} AS top10_concentration, n AS sample_size, n < 30 AS low_confidence
    FROM r, t, h WHERE rank <= 20""")
add("employers_concentration",
    lambda s, d: (m.top_employers(postings(s, d), employers(s, d), n=5, exact_concentration=True)
                  .select("rank", "employer_id", "count", "top10_concentration")),
    f"""{WITH}, t AS (SELECT count(*) AS n FROM p),
    c AS (SELECT employer_id, count(*) AS c FROM p JOIN customer ON c_custkey = employer_id GROUP BY 1),
    r AS (SELECT *, CAST(row_number() OVER (ORDER BY c DESC, employer_id) AS INTEGER) AS rank FROM c),
    h AS (SELECT sum(c) AS head FROM r WHERE rank <= 10)
    SELECT rank, employer_id, c AS "count", {SHARE.format('head', 'n')} AS top10_concentration FROM r, t, h WHERE rank <= 5""")
add("employers_dictionary", lambda s, d: views.employer_dictionary(postings(s, d), employers(s, d)),
    """SELECT c_custkey AS employer_id, c_name AS name, count(o_orderkey) AS postings FROM customer
    LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")

# --- distributions --------------------------------------------------------------------
_KEYS = {"grade": "CASE grade_id WHEN 1 THEN 'junior' WHEN 2 THEN 'middle' WHEN 3 THEN 'senior' ELSE 'unknown' END",
         "format": "coalesce(nullif(employment_format, ''), 'unknown')",
         "experience": "coalesce(nullif(experience_raw, ''), 'unknown')"}
_LABELS = {"grade": "upper(substr(k, 1, 1)) || substr(k, 2)",
           "format": "CASE k WHEN 'unknown' THEN 'Unknown' ELSE k END"}
for dimension, key in _KEYS.items():
    add(f"dist_{dimension}",
        lambda s, d, dimension=dimension: m.distribution(postings(s, d), dimension),
        f"""{WITH}, c AS (SELECT {key} AS k, count(*) AS c FROM p GROUP BY 1), t AS (SELECT count(*) AS n FROM p)
        SELECT k AS "key", {_LABELS.get(dimension, _LABELS['format'])} AS label, c AS "count",
        {SHARE.format('c', 'n')} AS share, n AS sample_size, n < 30 AS low_confidence FROM c, t""")

# --- SPEC metrics ---------------------------------------------------------------------
add("histogram", lambda s, d: premiums.salary_histogram(postings(s, d), 1_000_000),
    f"""{WITH} SELECT CAST(floor(estimate / 1000000) AS BIGINT) * 1000000 AS bin_start,
    CAST(floor(estimate / 1000000) AS BIGINT) * 1000000 + 1000000 AS bin_end, count(*) AS "count"
    FROM p WHERE estimate IS NOT NULL GROUP BY 1, 2""")
for method, low, high in (
        ("percentile", "quantile_cont(v, 0.01)", "quantile_cont(v, 0.99)"),
        ("iqr", "quantile_cont(v, 0.25) - 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25))",
         "quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25))")):
    add(f"trimmed_extremes_{method}",
        lambda s, d, method=method: premiums.trimmed_extremes(postings(s, d), "employment_format", method),
        f"""{WITH}, v AS (SELECT employment_format, CAST(estimate AS DOUBLE) AS v FROM p WHERE estimate IS NOT NULL),
        f AS (SELECT employment_format, round({low}, 6) AS lo, round({high}, 6) AS hi FROM v GROUP BY 1)
        SELECT employment_format, min(v) AS raw_min, max(v) AS raw_max, count(*) AS "count",
        min(v) FILTER (v BETWEEN lo AND hi) AS trimmed_min, max(v) FILTER (v BETWEEN lo AND hi) AS trimmed_max,
        count(*) FILTER (v BETWEEN lo AND hi) AS kept_count FROM v JOIN f USING (employment_format) GROUP BY 1""")
MEDIAN = "round(quantile_cont(CAST(estimate AS DOUBLE), 0.5) FILTER ({0}), 4)"
add("grade_premium", lambda s, d: premiums.grade_premium(postings(s, d)),
    f"""{WITH}, x AS (SELECT {MEDIAN.format('grade_id = 3')} AS a, {MEDIAN.format('grade_id = 1')} AS b FROM p
    WHERE estimate IS NOT NULL) SELECT a AS upper_median, b AS lower_median, round(a / b, 4) AS premium FROM x""")
add("remote_premium", lambda s, d: premiums.remote_premium(postings(s, d)),
    f"""{WITH}, x AS (SELECT {MEDIAN.format("employment_format = 'remote'")} AS a,
    {MEDIAN.format("employment_format = 'office'")} AS b FROM p WHERE estimate IS NOT NULL)
    SELECT a AS remote_median, b AS office_median, round(a - b, 4) AS premium FROM x""")
SKILL_PREMIUM = f"""{WITH}, e AS (SELECT * FROM p WHERE estimate IS NOT NULL), s AS (SELECT DISTINCT skill FROM sk),
    x AS (SELECT s.skill, e.estimate, sk.posting_id IS NOT NULL AS has FROM s CROSS JOIN e
          LEFT JOIN sk ON sk.skill = s.skill AND sk.posting_id = e.posting_id),
    y AS (SELECT skill, count(*) FILTER (has) AS n, {MEDIAN.format('has')} AS a, {MEDIAN.format('NOT has')} AS b
          FROM x GROUP BY 1)
    SELECT skill, n AS sample_size, a AS median_with, b AS median_without, round(a - b, 4) AS premium FROM y"""
add("skill_premium", lambda s, d: premiums.skill_premium(postings(s, d, "p_brand")), SKILL_PREMIUM)
# More skills than any top list holds.
add("skill_premium_names", lambda s, d: premiums.skill_premium(postings(s, d, "concat(p_name, ' ', p_brand)")),
    SKILL_PREMIUM.replace("p_brand AS skill", "p_name || ' ' || p_brand AS skill"))
add("salary_in_currency", lambda s, d: premiums.salary_in_currency(postings(s, d), "USD", "gross"),
    f"""{WITH} SELECT 'USD' AS currency, 'gross' AS basis,
    round(round(quantile_cont(CAST(estimate AS DOUBLE), 0.25), 4) / 90 / (1.0::DOUBLE - 0.13::DOUBLE), 4) AS p25,
    round(round(quantile_cont(CAST(estimate AS DOUBLE), 0.5), 4) / 90 / (1.0::DOUBLE - 0.13::DOUBLE), 4) AS p50,
    round(round(quantile_cont(CAST(estimate AS DOUBLE), 0.75), 4) / 90 / (1.0::DOUBLE - 0.13::DOUBLE), 4) AS p75
    FROM p WHERE estimate IS NOT NULL""")


def _sql_shown(columns):
    return ", ".join(f'round("{c}" / 90 / (1.0::DOUBLE - 0.13::DOUBLE), 4) AS "{c}"' if c in premiums._MONEY else f'"{c}"' for c in columns)


_SUMMARY = ("count", "total_count", *premiums._MONEY, "disclosure_rate", "low_confidence")
add("salary_summary_in_currency", lambda s, d: premiums.salary_summary_in_currency(postings(s, d), "USD", "gross", by=["grade_id"]),
    f"""{WITH}, st AS (SELECT grade_id, {STATS} FROM p GROUP BY grade_id)
    SELECT 'USD' AS currency, 'gross' AS basis, grade_id, {_sql_shown(_SUMMARY)} FROM st""")
add("salary_series_in_currency", lambda s, d: premiums.salary_series_in_currency(postings(s, d), "month", "USD", "gross"),
    f"""{WITH}, st AS (SELECT {TRUNC['month']} AS period_start, {', '.join(
        f'round(quantile_cont(CAST(estimate AS DOUBLE), {q}), 4) AS {n}' for n, q in (('median', 0.5), ('p25', 0.25), ('p75', 0.75)))},
      count(*) AS "count" FROM p WHERE estimate IS NOT NULL GROUP BY 1)
    SELECT 'USD' AS currency, 'gross' AS basis, period_start, {_sql_shown(('median', 'p25', 'p75', 'count'))} FROM st""")


def _exported(s, d):
    """Whole texts and the skill dictionary written as a table of text files and read back."""
    texts = load(s, d, "documents").select(F.lit("text").alias("kind"), F.col("doc_id").alias("number"), "text", F.col("lang").alias("label"))
    skills = views.skill_dictionary(postings(s, d, "p_name")).select(
        F.lit("skill").alias("kind"), F.col("postings").alias("number"), F.lit(None).cast("string").alias("text"), F.col("skill").alias("label"))
    rows = texts.unionByName(skills)
    path = f"{shared_dir(s)}/export-{uuid.uuid4().hex}"
    views.write_csv(rows, path)
    return views.read_csv(s, path, rows.schema)


add("csv_export", _exported,
    """SELECT 'text' AS kind, doc_id AS number, nullif(text, '') AS text, nullif(lang, '') AS label FROM documents
    UNION ALL SELECT 'skill', count(DISTINCT l_orderkey), NULL, p_name FROM lineitem JOIN part ON l_partkey = p_partkey
    JOIN orders ON o_orderkey = l_orderkey GROUP BY p_name""")


def _rates(s, d):
    """Dated rates derived from the order days: one per currency on some days only."""
    days = load(s, d, "orders").select(F.trunc("o_orderdate", "week").alias("rate_date")).distinct()
    number = F.datediff("rate_date", F.lit(dt.date(1990, 1, 1)))
    usd, eur = number % 3 == 0, number % 2 == 0
    rate = lambda base: F.lit(base).cast("decimal(14,6)") + (number % 17).cast("decimal(14,6)")
    return (days.where(usd).select(F.lit("USD").alias("currency"), "rate_date", rate("80").cast("decimal(14,6)").alias("rate"))
            .unionByName(days.where(eur).select(F.lit("EUR").alias("currency"), "rate_date",
                                                rate("95.5").cast("decimal(14,6)").alias("rate"))))


add("fx_asof",
    lambda s, d: premiums.convert_at_publication(postings(s, d), _rates(s, d)),
    f"""{WITH}, w AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS rate_date FROM orders),
    n AS (SELECT rate_date, date_diff('day', DATE '1990-01-01', rate_date) AS k FROM w),
    r AS (SELECT 'USD' AS c, rate_date, CAST(80 + k % 17 AS DECIMAL(14,6)) AS rt FROM n WHERE k % 3 = 0
          UNION ALL SELECT 'EUR', rate_date, CAST(95.5 + k % 17 AS DECIMAL(14,6)) FROM n WHERE k % 2 = 0),
    dd AS (SELECT DISTINCT currency, local_day FROM p WHERE currency IS NOT NULL),
    j AS (SELECT dd.currency, dd.local_day, r.rt, abs(date_diff('day', r.rate_date, dd.local_day)) AS dist,
          row_number() OVER (PARTITION BY dd.currency, dd.local_day
            ORDER BY abs(date_diff('day', r.rate_date, dd.local_day)), r.rate_date) AS rn
          FROM dd JOIN r ON r.c = dd.currency),
    q AS (SELECT p.posting_id, p.currency, p.local_day, CAST(coalesce(j.rt, 1) AS DECIMAL(14,6)) AS used, j.dist,
          p.salary_from, p.salary_to, keep FROM p LEFT JOIN j ON j.rn = 1 AND j.currency = p.currency AND j.local_day = p.local_day
          WHERE p.currency IS NOT NULL),
    z AS (SELECT *, CAST(CAST(salary_from AS DECIMAL(20,2)) * CAST(used AS DECIMAL(10,6)) * keep AS DECIMAL(14,2)) AS lo, CAST(CAST(salary_to AS DECIMAL(20,2)) * CAST(used AS DECIMAL(10,6)) * keep AS DECIMAL(14,2)) AS hi FROM q)
    SELECT posting_id, currency, local_day AS published_day, used AS rate, CAST(dist AS INTEGER) AS distance_days,
    coalesce(CAST((lo + hi) * 0.5 AS DECIMAL(14,2)), lo, hi) AS estimate FROM z""")

# --- views ----------------------------------------------------------------------------
_NAMES = "array_to_string(list({0} ORDER BY c DESC, {1}), '|')"


def _overview(s, d):
    view = views.overview(postings(s, d, "p_brand"), employers(s, d), digits=4)
    joined = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), "|")
    return view.select("median", "p25", "p75", "total_vacancies", "disclosure_rate", "demand_growth", "low_confidence",
                       joined("top_skills", "skill").alias("skills"), joined("top_employers", "name").alias("employers"),
                       joined("grade_distribution", "key").alias("grades"))


_TOPS = """, ks AS (SELECT skill, count(*) AS c FROM ps GROUP BY 1 ORDER BY c DESC, skill LIMIT {skills}),
  ke AS (SELECT employer_id, c_name, count(*) AS c FROM p JOIN customer ON c_custkey = employer_id GROUP BY 1, 2
         ORDER BY c DESC, employer_id LIMIT {employers}),
  kg AS (SELECT """ + _KEYS["grade"] + """ AS k, count(*) AS c FROM p GROUP BY 1),
  km AS (SELECT """ + TRUNC["month"] + """ AS period_start, count(*) AS c FROM p GROUP BY 1),
  kr AS (SELECT *, round(CAST(c - lag(c) OVER (ORDER BY period_start) AS DOUBLE) / lag(c) OVER (ORDER BY period_start), 4)
         AS growth, row_number() OVER (ORDER BY period_start DESC) AS back FROM km)"""
add("overview_flat", _overview,
    f"""{WITH} {_TOPS.format(skills=5, employers=5)}, st AS (SELECT {STATS} FROM p)
    SELECT median, p25, p75, total_count AS total_vacancies, disclosure_rate,
    (SELECT growth FROM kr WHERE back = 1) AS demand_growth, low_confidence,
    (SELECT {_NAMES.format('skill', 'skill')} FROM ks) AS skills,
    (SELECT {_NAMES.format('c_name', 'employer_id')} FROM ke) AS employers,
    (SELECT {_NAMES.format('k', 'k')} FROM kg) AS grades FROM st""")


def _last_months(s, d):
    context = views.market_context(postings(s, d, "p_brand"), employers(s, d), digits=4)
    return (context.select(F.explode("demand_trend").alias("t"), "salary", "top_skills", "top_employers", "format_distribution")
            .select("t.period", "t.count", "t.growth", F.col("salary.sample_size").alias("sample_size"),
                    F.col("salary.percentiles.p90").alias("p90"), F.size("top_skills").alias("skills"),
                    F.size("top_employers").alias("employers"), F.size("format_distribution").alias("formats")))


add("market_context_last6", _last_months,
    f"""{WITH} {_TOPS.format(skills=15, employers=10)}, st AS (SELECT {STATS} FROM p)
    SELECT period_start AS period, c AS "count", growth, st."count" AS sample_size, p90,
    CAST((SELECT count(*) FROM ks) AS INTEGER) AS skills, CAST((SELECT count(*) FROM ke) AS INTEGER) AS employers,
    CAST((SELECT count(DISTINCT employment_format) FROM p) AS INTEGER) AS formats FROM kr, st WHERE back <= 6""")


def _resume_context(s, d):
    context = views.resume_market_context(postings(s, d, "p_brand"), "senior", digits=4)
    return context.select(
        F.col("salary_all.median").alias("median"), F.col("salary_all.sample_size").alias("sample_size"),
        F.col("salary_grade.median").alias("grade_median"), F.col("salary_grade.total_vacancies").alias("grade_total"),
        F.array_join(F.transform("top_skills_grade", lambda x: x["name"]), "|").alias("grade_skills"),
        F.size("top_skills_all").alias("skills"))


add("resume_market_context", _resume_context,
    f"""{WITH}, a AS (SELECT {STATS} FROM p), g AS (SELECT {STATS} FROM p WHERE grade_id = 3),
    kg AS (SELECT skill, count(*) AS c FROM ps WHERE grade_id = 3 GROUP BY 1 ORDER BY c DESC, skill LIMIT 20)
    SELECT a.median, a."count" AS sample_size, g.median AS grade_median, g.total_count AS grade_total,
    (SELECT {_NAMES.format('skill', 'skill')} FROM kg) AS grade_skills,
    CAST((SELECT least(count(DISTINCT skill), 30) FROM ps) AS INTEGER) AS skills FROM a, g""")

LISTING = m.Slice(dt.date(1997, 1, 1), dt.date(1999, 12, 31), "middle")
add("posting_listing",
    lambda s, d: (views.posting_listing(postings(s, d, "p_brand"), employers(s, d), LISTING, skill="Brand#3",
                                        page=2, page_size=25)
                  .select("posting_id", "employer_id", "employer_name", "grade", "estimate", "employment_format",
                          "published_at", "total")),
    f"""{WITH}, f AS (SELECT p.* FROM p SEMI JOIN (SELECT posting_id FROM sk WHERE skill = 'Brand#3') x USING (posting_id)
    WHERE local_day BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND grade_id = 2)
    SELECT posting_id, employer_id, c_name AS employer_name, 'middle' AS grade, estimate, employment_format, published_at,
    (SELECT count(*) FROM f) AS total FROM f LEFT JOIN customer ON c_custkey = employer_id
    ORDER BY published_at DESC, posting_id LIMIT 25 OFFSET 25""")


# --- snapshots ------------------------------------------------------------------------
_SHARED = "count: bigint, share: double"
_PAYLOAD = f"""count bigint, total_count bigint, median double, min double, max double, mean double,
  percentiles struct<p10: double, p25: double, p50: double, p75: double, p90: double>, range_avg struct<from: double, to: double>,
  salary_disclosure_rate double, low_confidence boolean, sample_size bigint, top10_concentration double,
  skills array<struct<skill: string, canonical: string, {_SHARED}>>, employers array<struct<employer_id: bigint, name: string, {_SHARED}>>,
  pairs array<struct<a: string, b: string, {_SHARED}>>, distribution array<struct<key: string, label: string, {_SHARED}>>,
  points array<struct<period_start: string, count: bigint, growth: double, median: double, p25: double, p75: double>>,
  salary struct<median: double, p25: double, p75: double>, total_vacancies bigint, top_skills array<struct<skill: string, share: double>>,
  top_employers array<struct<name: string, count: bigint>>, grade_distribution array<struct<key: string, label: string, {_SHARED}>>, demand_growth_mom double"""


def _flat(rows):
    """Every value of every payload: one row per head, list item and group of figures."""
    c = F.col

    def part(name, n=None, item=None, other=None, v1=None, v2=None, v3=None):
        text, number = (item, other), (v1, v2, v3)
        null = F.lit(None)
        return F.struct(F.lit(name).alias("part"), F.lit(0).alias("pos"), *[(null if x is None else x).cast("string").alias(k) for k, x in zip(("item", "other"), text)],
                        (null if n is None else n).cast("long").alias("n"), *[(null if x is None else x).cast("double").alias(k) for k, x in zip(("v1", "v2", "v3"), number)])

    def items(column, **fields):
        return F.transform(c(column), lambda x, i: part(column, **{k: x[f] for k, f in fields.items()}).withField("pos", (i + 1).cast("int")))

    shared = {"n": "count", "v1": "share"}
    head = part("head", F.coalesce("count", "sample_size", "total_vacancies"), c("low_confidence"), None, F.coalesce("top10_concentration", "salary_disclosure_rate"),
                c("demand_growth_mom"))
    salary = [part("spread", c("total_count"), v1=c("median"), v2=c("min"), v3=c("max")), part("mean", v1=c("mean"), v2=c("range_avg.from"), v3=c("range_avg.to")),
              part("low", v1=c("percentiles.p10"), v2=c("percentiles.p25"), v3=c("percentiles.p50")), part("high", v1=c("percentiles.p75"), v2=c("percentiles.p90"))]
    lists = [items("skills", item="skill", other="canonical", **shared), items("employers", item="name", other="employer_id", **shared),
             items("pairs", item="a", other="b", **shared), items("distribution", item="key", other="label", **shared),
             items("grade_distribution", item="key", other="label", **shared), items("top_skills", item="skill", v1="share"), items("top_employers", item="name", n="count"),
             F.when(c("metric_type") == "demand_trend", items("points", item="period_start", n="count", v1="growth"))
             .otherwise(items("points", item="period_start", n="count", v1="median", v2="p25", v3="p75"))]
    every = [F.array(head), F.when(c("metric_type") == "salary", F.array(*salary)),
             F.when(c("metric_type") == "overview", F.array(part("salary", v1=c("salary.median"), v2=c("salary.p25"), v3=c("salary.p75")))), *lists]
    keys = ["metric_type", "period_type", "period_start", "grade_id", "currency", "gross_basis"]
    parsed = rows.select(*keys, F.from_json("payload", _PAYLOAD).alias("p")).select(*keys, "p.*")
    return parsed.select(*keys, F.explode(F.concat(*[F.coalesce(x, F.array()) for x in every])).alias("e")).select(*keys, "e.*")


_SLICES = "(SELECT * FROM (VALUES (0), (1), (2), (3), (4)) v(slice))"
_TOP_OF = """{name} AS (SELECT slice, CAST(row_number() OVER (PARTITION BY slice ORDER BY c DESC, {tie}) AS INTEGER) AS pos, item, other, c, c / CAST(z.n AS DOUBLE) AS raw
  FROM ({rows}) JOIN z USING (slice) QUALIFY pos <= {n})"""
_ROW = "'{0}', z.slice, CAST(NULL AS VARCHAR), '{1}', 0, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), {2}, {3}, {4}, {5}"
_LISTED = "SELECT '{0}', slice, NULL, '{1}', pos, item, other, {2}, {3}, NULL, NULL FROM {4}"
# A metric's rows: metric_type, slice, period_type (of the series), part, pos, item, other, n, v1, v2, v3
SNAPSHOT_SQL = f"""{WITH}, x AS (SELECT s.slice, p.* FROM p JOIN {_SLICES} s ON s.slice = 0 OR s.slice = p.grade_id),
  xs AS (SELECT slice, x.posting_id, skill FROM x JOIN sk USING (posting_id)),
  z AS (SELECT v.slice, count(x.posting_id) AS n, count(x.estimate) AS paid, min(x.local_day) AS ignored FROM {_SLICES} v LEFT JOIN x ON x.slice = v.slice GROUP BY 1),
  st AS (SELECT slice, {STATS} FROM x GROUP BY slice),
  {_TOP_OF.format(name='ks', n=20, tie='item', rows='SELECT slice, skill AS item, skill AS other, count(*) AS c FROM xs GROUP BY 1, 2')},
  {_TOP_OF.format(name='ke', n=20, tie='CAST(other AS BIGINT)', rows='SELECT slice, c_name AS item, CAST(employer_id AS VARCHAR) AS other, count(*) AS c FROM x JOIN customer ON c_custkey = employer_id GROUP BY 1, 2, 3')},
  {_TOP_OF.format(name='kp', n=20, tie='item, other', rows='SELECT l.slice, l.skill AS item, r.skill AS other, count(*) AS c FROM xs l JOIN xs r ON l.slice = r.slice AND l.posting_id = r.posting_id AND l.skill < r.skill GROUP BY 1, 2, 3')},
  {_TOP_OF.format(name='kf', n=99, tie='item', rows="SELECT slice, coalesce(nullif(employment_format, ''), 'unknown') AS item, CASE WHEN item = 'unknown' THEN 'Unknown' ELSE item END AS other, count(*) AS c FROM x GROUP BY 1, 2")},
  {_TOP_OF.format(name='kx', n=99, tie='item', rows="SELECT slice, coalesce(nullif(experience_raw, ''), 'unknown') AS item, CASE WHEN item = 'unknown' THEN 'Unknown' ELSE item END AS other, count(*) AS c FROM x GROUP BY 1, 2")},
  kg AS (SELECT slice, CAST(row_number() OVER (PARTITION BY slice ORDER BY c DESC, item) AS INTEGER) AS pos, item, upper(item[1:1]) || item[2:] AS other, c,
         c / CAST((SELECT count(*) FROM p) AS DOUBLE) AS raw FROM (SELECT {_KEYS['grade']} AS item, count(*) AS c FROM p GROUP BY 1) CROSS JOIN {_SLICES}),
  pt AS (SELECT unnest(['day', 'week', 'month', 'year']) AS period_type),
  bk AS (SELECT x.slice, period_type, CAST(CASE period_type WHEN 'day' THEN local_day ELSE date_trunc(period_type, local_day) END AS DATE) AS b, estimate FROM x, pt),
  dm AS (SELECT slice, period_type, b, count(*) AS c, lag(count(*)) OVER w AS was, CAST(row_number() OVER w AS INTEGER) AS pos,
         round(CAST(c - was AS DOUBLE) / was, 4) AS growth FROM bk GROUP BY 1, 2, 3 WINDOW w AS (PARTITION BY slice, period_type ORDER BY b)),
  ds AS (SELECT slice, period_type, b, count(*) AS c, CAST(row_number() OVER (PARTITION BY slice, period_type ORDER BY b) AS INTEGER) AS pos,
         quantile_cont(CAST(estimate AS DOUBLE), [0.5, 0.25, 0.75]) AS q FROM bk WHERE estimate IS NOT NULL GROUP BY 1, 2, 3),
  gm AS (SELECT slice, arg_max(growth, b) AS growth, arg_max(was IS NULL, b) AS none FROM dm WHERE period_type = 'month' GROUP BY 1),
  facts(metric_type, slice, kind, part, pos, item, other, n, v1, v2, v3) AS (
    SELECT 'salary', z.slice, CAST(NULL AS VARCHAR), 'head', 0, CAST(paid < 30 AS VARCHAR), CAST(NULL AS VARCHAR), paid, disclosure_rate, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
      FROM z LEFT JOIN st USING (slice)
    UNION ALL SELECT {_ROW.format('salary', 'spread', 'z.n', 'median', '"min"', '"max"')} FROM z LEFT JOIN st USING (slice)
    UNION ALL SELECT {_ROW.format('salary', 'mean', 'NULL', 'mean', 'range_from', 'range_to')} FROM z LEFT JOIN st USING (slice)
    UNION ALL SELECT {_ROW.format('salary', 'low', 'NULL', 'p10', 'p25', 'p50')} FROM z LEFT JOIN st USING (slice)
    UNION ALL SELECT {_ROW.format('salary', 'high', 'NULL', 'p75', 'p90', 'NULL')} FROM z LEFT JOIN st USING (slice)
    UNION ALL SELECT m, z.slice, NULL, 'head', 0, CAST(n < 30 AS VARCHAR), NULL, n, NULL, NULL, NULL
      FROM z, (SELECT unnest(['skills', 'skill_cooccurrence', 'format_distribution', 'experience_distribution']) AS m)
    UNION ALL SELECT 'grade_distribution', slice, NULL, 'head', 0, CAST((SELECT count(*) FROM p) < 30 AS VARCHAR), NULL, (SELECT count(*) FROM p), NULL, NULL, NULL FROM z
    UNION ALL SELECT 'employers', z.slice, NULL, 'head', 0, CAST(z.n < 30 AS VARCHAR), NULL, z.n,
      coalesce(round(CAST((SELECT sum(c) FROM ke WHERE ke.slice = z.slice AND pos <= 10) AS DOUBLE) / nullif(z.n, 0), 4), 0), NULL, NULL FROM z
    UNION ALL {_LISTED.format('skills', 'skills', 'c', 'round(raw, 4)', 'ks')} UNION ALL {_LISTED.format('employers', 'employers', 'c', 'round(raw, 4)', 'ke')}
    UNION ALL {_LISTED.format('skill_cooccurrence', 'pairs', 'c', 'round(raw, 4)', 'kp')} UNION ALL {_LISTED.format('format_distribution', 'distribution', 'c', 'round(raw, 4)', 'kf')}
    UNION ALL {_LISTED.format('experience_distribution', 'distribution', 'c', 'round(raw, 4)', 'kx')} UNION ALL {_LISTED.format('grade_distribution', 'distribution', 'c', 'round(raw, 4)', 'kg')}
    UNION ALL SELECT 'overview', z.slice, NULL, 'head', 0, CAST(paid < 30 AS VARCHAR), NULL, z.n, disclosure_rate, growth, NULL FROM z LEFT JOIN st USING (slice) LEFT JOIN gm USING (slice)
    UNION ALL SELECT {_ROW.format('overview', 'salary', 'NULL', 'median', 'p25', 'p75')} FROM z LEFT JOIN st USING (slice)
    UNION ALL {_LISTED.format('overview', 'grade_distribution', 'c', 'round(raw, 4)', 'kg')}
    UNION ALL SELECT 'overview', slice, NULL, 'top_skills', pos, item, NULL, NULL, round(raw, 4), NULL, NULL FROM ks WHERE pos <= 5
    UNION ALL SELECT 'overview', slice, NULL, 'top_employers', pos, item, NULL, c, NULL, NULL, NULL FROM ke WHERE pos <= 5
    UNION ALL SELECT m, z.slice, period_type, 'head', 0, CAST(coalesce(CASE m WHEN 'demand_trend' THEN z.n ELSE paid END, 0) < 30 AS VARCHAR), NULL, NULL, NULL, NULL, NULL
      FROM z, pt, (SELECT unnest(['demand_trend', 'salary_timeseries']) AS m)
    UNION ALL SELECT 'demand_trend', slice, period_type, 'points', pos, CAST(b AS VARCHAR), NULL, c, growth, NULL, NULL FROM dm
    UNION ALL SELECT 'salary_timeseries', slice, period_type, 'points', pos, CAST(b AS VARCHAR), NULL, c, round(q[1], 4), round(q[2], 4), round(q[3], 4) FROM ds)
  SELECT metric_type, pt.period_type, CAST(CASE pt.period_type WHEN 'day' THEN first_day ELSE date_trunc(pt.period_type, first_day) END AS DATE) AS period_start,
  nullif(slice, 0) AS grade_id, 'RUB' AS currency, false AS gross_basis, part, pos, item, other, CAST(n AS BIGINT) AS n, v1, v2, v3
  FROM facts JOIN pt ON kind IS NULL OR kind = pt.period_type CROSS JOIN (SELECT min(local_day) AS first_day FROM p)"""


add("snapshot_matrix", lambda s, d: _flat(snapshots.build_snapshots(postings(s, d, "p_brand"), employers(s, d), digits=4, mean_digits=6)), SNAPSHOT_SQL)


def _upserted(s, d):
    """A first build over the postings before 1998, a second one of two metrics over all; the second replaces its own rows only."""
    fact, firms = postings(s, d, "p_brand"), employers(s, d)
    before = m.Slice(date_to=dt.date(1997, 12, 31)).apply(fact)
    rows = snapshots.replace_snapshots(snapshots.build_snapshots(before, firms), snapshots.build_snapshots(fact, firms, metric_types=["salary", "grade_distribution"]))
    size = F.coalesce(F.get_json_object("payload", "$.total_count"), F.get_json_object("payload", "$.sample_size"))
    return rows.groupBy("metric_type", "period_type", "period_start", "grade_id", size.cast("long").alias("size")).agg(F.count("*").alias("rows"))


add("snapshot_upsert", _upserted,
    f"""{WITH}, c AS (SELECT v.slice, v.before, count(p.posting_id) AS n, v.first_day FROM (
      SELECT * FROM {_SLICES}, (VALUES (true), (false)) b(before), (SELECT min(local_day) AS first_day FROM p)) v
      LEFT JOIN p ON (v.slice = 0 OR v.slice = p.grade_id) AND (NOT v.before OR p.local_day <= DATE '1997-12-31') GROUP BY ALL),
    mt AS (SELECT * FROM (VALUES ('salary', false), ('grade_distribution', false), ('skills', true), ('employers', true), ('demand_trend', NULL), ('salary_timeseries', NULL),
      ('format_distribution', true), ('experience_distribution', true), ('skill_cooccurrence', true), ('overview', NULL)) v(metric_type, old)),
    pt AS (SELECT unnest(['day', 'week', 'month', 'year']) AS period_type)
    SELECT metric_type, period_type, CAST(CASE period_type WHEN 'day' THEN first_day ELSE date_trunc(period_type, first_day) END AS DATE) AS period_start,
    nullif(slice, 0) AS grade_id, CASE WHEN metric_type = 'grade_distribution' THEN (SELECT max(n) FROM c WHERE NOT before) WHEN old IS NOT NULL THEN n END AS size, CAST(1 AS BIGINT) AS rows
    FROM c JOIN mt ON before = coalesce(old, false) CROSS JOIN pt""")
add("snapshot_salary",
    lambda s, d: (snapshots.salary_per_bucket(postings(s, d), "month", digits=4)
                  .select("grade_id", "period_start", "count", "total_count", "median", "p25", "p75", "disclosure_rate")),
    f"""{WITH}, x AS (SELECT unnest([0, grade_id]) AS slice, p.* FROM p)
    SELECT nullif(slice, 0) AS grade_id, {TRUNC['month']} AS period_start, count(estimate) AS "count", count(*) AS total_count,
    round(quantile_cont(CAST(estimate AS DOUBLE), 0.5), 4) AS median, round(quantile_cont(CAST(estimate AS DOUBLE), 0.25), 4) AS p25,
    round(quantile_cont(CAST(estimate AS DOUBLE), 0.75), 4) AS p75,
    round(CAST(count(estimate) AS DOUBLE) / count(*), 4) AS disclosure_rate FROM x WHERE slice IS NOT NULL GROUP BY slice, 2""")
