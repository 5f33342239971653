"""The driver tables seen as a job market: orders are postings, customers employers,
parts on the order lines skills. Everything is derived by Spark from whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobspectra.functions.salary import with_salary

GRADE_OF_PRIORITY = {"1-URGENT": 3, "2-HIGH": 3, "3-MEDIUM": 2, "5-LOW": 1}
FORMAT_OF_STATUS = {"O": "office", "F": "remote", "P": "hybrid"}
EXPERIENCES = ["noExperience", "between1And3", "between3And6", "moreThan6", "Нет опыта", "От 3 до 6 лет", ""]
TITLES = ["Junior Frontend-разработчик (React)", "Senior Frontend Developer (Vue.js / TypeScript)",
          "Верстальщик / Frontend developer", "Fullstack-разработчик (Node.js + React)",
          "Backend-разработчик Python (Django)", "Руководитель проектов (IT)",
          "QA Engineer / Тестировщик", "DevOps Engineer", "Системный аналитик", "UI/UX Дизайнер",
          "Frontend developer", "Ведущий Frontend-разработчик", "Middle Angular developer", "Tech lead web"]
DESCRIPTIONS = ["Ищем frontend-разработчика с знанием React, JavaScript.",
                "Backend на Node.js, frontend на React.", "Адаптивная верстка, HTML, CSS.",
                "REST API, PostgreSQL, Redis.", "Нужен middle с опытом.", "", "Team lead, agile и scrum."]
SKILLS_RAW = ["React", "react", "  React ", "JavaScript", "javascript", "Vue.js", "vue.js",
              "Type  Script", "HTML", "  ", "CSS", "css"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(table: DataFrame) -> DataFrame:
    """A stored table dealt to all cores where its files make fewer tasks than that, for heavy work on each row."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(4 * cores) if table.rdd.getNumPartitions() < 2 * cores else table


def choose(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))).cast("int"))


def _case(values: dict, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + " END"


RAW_SALARY = {
    "salary_from": ("CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 1 THEN "
                    "CAST(CAST(o_totalprice AS decimal(14,2)) * 0.9 AS decimal(14,2)) END"),
    "salary_to": ("CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 2 THEN "
                  "CAST(CAST(o_totalprice AS decimal(14,2)) * 1.1 AS decimal(14,2)) END"),
    "salary_currency": "CASE o_orderkey % 4 WHEN 0 THEN 'RUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' END",
    "salary_gross": "CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END",
}


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_from_orders(load(spark, sf_dir, "orders"))


def raw_from_orders(orders: DataFrame) -> DataFrame:
    """Raw posting rows with texts, one per order, with ``seq`` as the sighting order."""
    key, employer = F.col("o_orderkey"), F.col("o_custkey")
    null = F.lit(None).cast("string")
    skills = F.array(*[choose(SKILLS_RAW, key + i * employer) for i in range(4)])
    return orders.select(
        key.alias("posting_id"), choose(TITLES, key + employer).alias("title"),
        F.concat(F.lit("https://jobs.example.com/vacancy/"), key, F.lit("?from=search")).alias("url"),
        F.concat(F.lit("Employer "), employer).alias("employer_name"), employer.alias("employer_id"),
        F.concat(F.lit("/employer/"), employer).alias("employer_url"),
        *[F.expr(e).alias(n) for n, e in RAW_SALARY.items()],
        choose(EXPERIENCES, key + 3 * employer).alias("experience_raw"),
        F.expr(_case(FORMAT_OF_STATUS, "o_orderstatus")).alias("employment_format"), null.alias("area_name"),
        F.col("o_orderdate").alias("published_at"), choose(DESCRIPTIONS, employer).alias("description"),
        F.when(key % 9 == 0, F.array().cast("array<string>")).otherwise(skills).alias("skills"),
        F.lit("api").alias("source_type"), null.alias("raw_html"), null.alias("raw_payload"), key.alias("seq"))


def postings(spark: SparkSession, sf_dir: str, skills: str | None = None) -> DataFrame:
    """Stored postings; ``skills`` is the part column, or SQL over part columns, that plays the skill."""
    experience = ", ".join(f"'{e}'" for e in EXPERIENCES)
    raw = load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS posting_id", "concat('Posting ', o_orderkey) AS title",
        "concat('https://jobs.example.com/vacancy/', o_orderkey) AS url", "o_custkey AS employer_id",
        f"{_case(GRADE_OF_PRIORITY, 'o_orderpriority')} AS grade_id",
        f"get(array({experience}), CAST((o_orderkey + 3 * o_custkey) % {len(EXPERIENCES)} AS int)) AS experience_raw",
        f"{_case(FORMAT_OF_STATUS, 'o_orderstatus')} AS employment_format", "o_orderdate AS published_at",
        *[f"{e} AS {n}" for n, e in RAW_SALARY.items()])
    base = with_salary(raw)
    if skills is None:
        return base
    per_posting = links(spark, sf_dir, skills).groupBy("posting_id").agg(F.collect_set("skill").alias("_skills"))
    joined = base.join(per_posting.withColumnRenamed("posting_id", "_id"), F.expr("posting_id = _id"), "left")
    return joined.selectExpr(*base.columns, "coalesce(_skills, CAST(array() AS array<string>)) AS skills")


def links(spark: SparkSession, sf_dir: str, skills: str = "p_brand") -> DataFrame:
    """(posting_id, skill) sightings, repeats included.

    Parts grow with the lines, and their files are far smaller than their rows in memory,
    which must not be gathered on the driver to be broadcast: both sides are shuffled.
    """
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = load(spark, sf_dir, "part").select("p_partkey", F.expr(skills).alias("skill"))
    joined = lines.join(parts.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("l_orderkey").alias("posting_id"), "skill")


def employers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("employer_id"), F.col("c_name").alias("name"),
        F.concat(F.lit("/employer/"), "c_custkey").alias("url"))


# --- the same bindings for the SQL check ------------------------------------------------

def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_choose(values: list[str], index: str) -> str:
    return f"{sql_list(values)}[cast(({index}) % {len(values)} as int) + 1]"


SQL_GRADE = ("CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 "
             "WHEN '5-LOW' THEN 1 END")
SQL_FORMAT = "CASE o_orderstatus WHEN 'O' THEN 'office' WHEN 'F' THEN 'remote' WHEN 'P' THEN 'hybrid' END"
SQL_RAW_SALARY = """
  CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 1
       THEN CAST(CAST(o_totalprice AS DECIMAL(14,2)) * 0.9 AS DECIMAL(14,2)) END AS salary_from,
  CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 2
       THEN CAST(CAST(o_totalprice AS DECIMAL(14,2)) * 1.1 AS DECIMAL(14,2)) END AS salary_to,
  CASE o_orderkey % 4 WHEN 0 THEN 'RUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' END AS salary_currency,
  CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS salary_gross"""
SQL_RATE = ("CASE currency WHEN 'RUR' THEN 1 WHEN 'RUB' THEN 1 WHEN 'USD' THEN 90 WHEN 'EUR' THEN 100 "
            "WHEN 'KZT' THEN 0.2 WHEN 'UAH' THEN 2.5 WHEN 'BYR' THEN 28 WHEN 'GEL' THEN 34 "
            "WHEN 'UZS' THEN 0.007 ELSE 1 END")


def sql_normalize(source: str, prefix: str = "s") -> str:
    """CTEs that add the net columns to a relation with raw salary columns."""
    return f"""
{prefix}1 AS (SELECT *, CASE WHEN salary_from IS NOT NULL OR salary_to IS NOT NULL
                 THEN upper(coalesce(nullif(salary_currency, ''), 'RUR')) END AS currency FROM {source}),
{prefix}2 AS (SELECT *, CAST({SQL_RATE} AS DECIMAL(10,6)) AS rate,
         CAST(CASE WHEN coalesce(salary_gross, true) THEN 0.87 ELSE 1 END AS DECIMAL(5,4)) AS keep FROM {prefix}1),
{prefix}3 AS (SELECT *, CAST(CAST(nullif(salary_from, 0) AS DECIMAL(20,2)) * rate * keep AS DECIMAL(14,2)) AS from_net,
         CAST(CAST(nullif(salary_to, 0) AS DECIMAL(20,2)) * rate * keep AS DECIMAL(14,2)) AS to_net FROM {prefix}2),
{prefix}4 AS (SELECT *, coalesce(CAST((from_net + to_net) * 0.5 AS DECIMAL(14,2)), from_net, to_net) AS estimate
         FROM {prefix}3)"""


SQL_POSTINGS = f"""
base AS (SELECT o_orderkey AS posting_id, o_custkey AS employer_id, {SQL_GRADE} AS grade_id,
  {sql_choose(EXPERIENCES, 'o_orderkey + 3 * o_custkey')} AS experience_raw,
  {SQL_FORMAT} AS employment_format, o_orderdate AS published_at,
  CAST(o_orderdate + INTERVAL 3 HOUR AS DATE) AS local_day, {SQL_RAW_SALARY}
  FROM orders),
{sql_normalize('base')},
p AS (SELECT * FROM s4),
sk AS (SELECT DISTINCT l_orderkey AS posting_id, p_brand AS skill FROM lineitem JOIN part ON l_partkey = p_partkey),
ps AS (SELECT p.*, sk.skill FROM p JOIN sk USING (posting_id))"""

SQL_SKILLS = "[" + ", ".join(sql_choose(SKILLS_RAW, f"o_orderkey + {i} * o_custkey") for i in range(4)) + "]"
SQL_CANONICAL = (r"list_filter(list_transform({0}, lambda x: trim(lower(regexp_replace(x, '\s+', ' ', 'g')))), "
                 "lambda x: x <> '')")
SQL_RAW = f"""
rw AS (SELECT o_orderkey AS posting_id, {sql_choose(TITLES, 'o_orderkey + o_custkey')} AS title,
  'https://jobs.example.com/vacancy/' || o_orderkey || '?from=search' AS url, 'Employer ' || o_custkey AS employer_name,
  o_custkey AS employer_id, {SQL_RAW_SALARY}, {sql_choose(EXPERIENCES, 'o_orderkey + 3 * o_custkey')} AS experience_raw,
  {SQL_FORMAT} AS employment_format, o_orderdate AS published_at, {sql_choose(DESCRIPTIONS, 'o_custkey')} AS description,
  CASE WHEN o_orderkey % 9 = 0 THEN [] ELSE {SQL_SKILLS} END AS skills FROM orders)"""


def sql_bounded(words: str) -> str:
    """A pattern for whole words that treats all letters and digits as word characters."""
    return r"(^|[^\p{L}\p{N}_])(" + words + r")([^\p{L}\p{N}_]|$)"


def sql_distinct_in_order(items: str) -> str:
    """A list without repeats, first occurrences kept in order."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"
