"""Tables, enumerations and the constants shared by all metrics."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values of the metric catalogue -------------------------------------------
LOW_CONFIDENCE_BELOW = 30
PERCENTILES = (10, 25, 50, 75, 90)
TOP_N = 20
MAX_TOP_N = 100
CONCENTRATION_TOP = 10
TAX_RATE = "0.13"
UTC_OFFSET_HOURS = 3
PERIOD_TYPES = ("day", "week", "month", "year")
METRIC_TYPES = (
    "salary",
    "skills",
    "employers",
    "demand_trend",
    "salary_timeseries",
    "grade_distribution",
    "format_distribution",
    "experience_distribution",
    "skill_cooccurrence",
    "overview",
)
GRADES = ((1, "junior", "Junior", 1), (2, "middle", "Middle", 2),
          (3, "senior", "Senior", 3), (4, "unknown", "Unknown", 4))
# -------------------------------------------------------------------------------------

GRADE_IDS = {code: grade_id for grade_id, code, _, _ in GRADES}

MONEY = T.DecimalType(14, 2)
RATE = T.DecimalType(14, 6)

RAW_POSTING = T.StructType([
    T.StructField("posting_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("employer_name", T.StringType()),
    T.StructField("employer_id", T.LongType()),
    T.StructField("employer_url", T.StringType()),
    T.StructField("salary_from", MONEY),
    T.StructField("salary_to", MONEY),
    T.StructField("salary_currency", T.StringType()),
    T.StructField("salary_gross", T.BooleanType()),
    T.StructField("experience_raw", T.StringType()),
    T.StructField("employment_format", T.StringType()),
    T.StructField("area_name", T.StringType()),
    T.StructField("published_at", T.TimestampNTZType()),
    T.StructField("description", T.StringType()),
    T.StructField("skills", T.ArrayType(T.StringType())),
    T.StructField("source_type", T.StringType()),
    T.StructField("raw_html", T.StringType()),
    T.StructField("raw_payload", T.StringType()),
])

SALARY_COLUMNS = ("amount_from", "amount_to", "currency", "gross",
                  "from_net", "to_net", "estimate")

# The stored fact: salary (1:1) and skills (1:n, de-duplicated) live on the posting, so
# no metric needs a join to reach them.
POSTING = T.StructType([
    T.StructField("posting_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("employer_id", T.LongType()),
    T.StructField("grade_id", T.IntegerType()),
    T.StructField("experience_raw", T.StringType()),
    T.StructField("employment_format", T.StringType()),
    T.StructField("area_name", T.StringType()),
    T.StructField("published_at", T.TimestampNTZType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("raw_html", T.StringType()),
    T.StructField("raw_payload", T.StringType()),
    T.StructField("amount_from", MONEY),
    T.StructField("amount_to", MONEY),
    T.StructField("currency", T.StringType()),
    T.StructField("gross", T.BooleanType()),
    T.StructField("from_net", MONEY),
    T.StructField("to_net", MONEY),
    T.StructField("estimate", MONEY),
    T.StructField("skills", T.ArrayType(T.StringType())),
    T.StructField("run_id", T.StringType()),
    T.StructField("first_seen_at", T.TimestampNTZType()),
    T.StructField("last_seen_at", T.TimestampNTZType()),
])

TERM = T.StructType([
    T.StructField("ord", T.IntegerType()),
    T.StructField("term", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("field_scope", T.StringType()),
    T.StructField("weight", T.DecimalType(6, 2)),
    T.StructField("active", T.BooleanType()),
])

REJECT = T.StructType([
    T.StructField("posting_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("matched_stopword", T.StringType()),
    T.StructField("run_id", T.StringType()),
])

RUN = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("started_at", T.TimestampNTZType()),
    T.StructField("finished_at", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
    T.StructField("found_total", T.LongType()),
    T.StructField("created_count", T.LongType()),
    T.StructField("updated_count", T.LongType()),
    T.StructField("filtered_count", T.LongType()),
    T.StructField("error_count", T.LongType()),
    T.StructField("captcha_count", T.LongType()),
    T.StructField("meta", T.StringType()),
])

SNAPSHOT = T.StructType([
    T.StructField("metric_type", T.StringType()),
    T.StructField("period_type", T.StringType()),
    T.StructField("period_start", T.DateType()),
    T.StructField("grade_id", T.IntegerType()),
    T.StructField("currency", T.StringType()),
    T.StructField("gross_basis", T.BooleanType()),
    T.StructField("payload", T.StringType()),
])
