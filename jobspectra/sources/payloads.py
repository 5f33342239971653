"""Landed JSON payloads to raw postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobspectra.functions import fields
from jobspectra.schema import MONEY

PAYLOAD_SCHEMA = """
    id string, name string, alternate_url string, description string, published_at string,
    salary struct<`from`: decimal(14,2), `to`: decimal(14,2), currency: string, gross: boolean>,
    employer struct<id: string, name: string, alternate_url: string>,
    experience struct<id: string>, schedule struct<id: string>, area struct<name: string>,
    key_skills array<struct<name: string>>
"""


def raw_postings(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Raw posting rows; unreadable dates give NULL, zero amounts count as missing."""
    p = payloads.select(F.from_json(column, PAYLOAD_SCHEMA).alias("p"), F.col(column).alias("raw"))
    zero = F.lit(0).cast(MONEY)
    names = F.filter(F.transform("p.key_skills", lambda s: s["name"]), lambda s: s.isNotNull())
    return p.select(
        F.col("p.id").try_cast("long").alias("posting_id"),
        F.coalesce("p.name", F.lit("")).alias("title"), F.col("p.alternate_url").alias("url"),
        F.col("p.employer.name").alias("employer_name"),
        F.col("p.employer.id").try_cast("long").alias("employer_id"),
        F.col("p.employer.alternate_url").alias("employer_url"),
        F.nullif(F.col("p.salary.from"), zero).alias("salary_from"),
        F.nullif(F.col("p.salary.to"), zero).alias("salary_to"),
        F.col("p.salary.currency").alias("salary_currency"),
        F.col("p.salary.gross").alias("salary_gross"),
        F.col("p.experience.id").alias("experience_raw"),
        fields.schedule_format(F.coalesce("p.schedule.id", F.lit(""))).alias("employment_format"),
        F.col("p.area.name").alias("area_name"),
        fields.iso_timestamp(F.col("p.published_at")).alias("published_at"),
        F.coalesce("p.description", F.lit("")).alias("description"),
        F.coalesce(names, F.array().cast("array<string>")).alias("skills"),
        F.lit("api").alias("source_type"), F.lit(None).cast("string").alias("raw_html"),
        F.col("raw").alias("raw_payload"))
