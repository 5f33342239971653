"""Idempotent keyed merges.

A merge never shuffles the target for the rows it keeps: batch keys (small, and
broadcast by AQE when their measured size allows) filter the target by anti and semi
joins, and only matched rows meet the batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobspectra.functions.fields import canonical_skill
from jobspectra.schema import POSTING

KEPT_ON_MATCH = ("published_at", "first_seen_at", "run_id")


def last_per_key(batch: DataFrame, key: str, seq: str, first: Sequence[str] = ()) -> DataFrame:
    """One row per key: values of the last sighting, except ``first`` of the earliest.

    Uses aggregates, not a window, so a key repeated millions of times is combined
    before the shuffle. Skills come from the last sighting that had any, and are empty without one.
    """
    others = [c for c in batch.columns if c not in (key, seq, *first, "skills")]
    aggregates = [F.max_by(F.struct(*others), seq).alias("_last")]
    aggregates += [F.min_by(c, seq).alias(c) for c in first]
    if "skills" in batch.columns:
        latest = F.max_by("skills", F.when(F.size("skills") > 0, F.col(seq)))
        aggregates.append(F.coalesce(latest, F.array().cast("array<string>")).alias("skills"))
    merged = batch.groupBy(key).agg(*aggregates)
    return merged.select(key, "_last.*", *first, *(["skills"] if "skills" in batch.columns else []))


def merge_batch(target: DataFrame, batch: DataFrame, run_id: str, seen_at: Column, *,
                purge_skills: bool = False) -> DataFrame:
    """The batch rows as they will be stored, with ``is_created``.

    New postings are stamped; known ones keep their publication date, first sighting and
    first run. A salary that vanished becomes NULL. Skills are replaced when the batch
    has any; an empty list leaves the stored ones unless ``purge_skills``.
    """
    keys = batch.select("posting_id")
    known = (target.join(keys, "posting_id", "left_semi")
             .select("posting_id", F.lit(True).alias("_known"), F.col("skills").alias("_skills"),
                     *[F.col(c).alias(f"_{c}") for c in KEPT_ON_MATCH]))
    rows = batch.join(known, "posting_id", "left")
    is_known = F.col("_known").isNotNull()
    fresh = {"published_at": F.col("published_at"), "first_seen_at": seen_at, "run_id": F.lit(run_id)}
    no_skills = F.array().cast("array<string>")
    skills = F.coalesce("skills", no_skills)
    if not purge_skills:
        skills = F.when(is_known & (F.size(skills) == 0), F.coalesce("_skills", no_skills)).otherwise(skills)
    values = {c: F.when(is_known, F.col(f"_{c}")).otherwise(v) for c, v in fresh.items()}
    values["skills"], values["last_seen_at"] = skills, seen_at
    return rows.select(*[values.get(c, F.col(c)).alias(c) for c in POSTING.names],
                       (~is_known).alias("is_created"))


def apply_batch(target: DataFrame, merged: DataFrame) -> DataFrame:
    """Target with the merged rows in place of their old versions."""
    names = POSTING.names
    untouched = target.select(*names).join(merged.select("posting_id"), "posting_id", "left_anti")
    return untouched.unionByName(merged.select(*names))


def upsert_postings(target: DataFrame, batch: DataFrame, run_id: str, seen_at: Column, *,
                    purge_skills: bool = False) -> DataFrame:
    return apply_batch(target, merge_batch(target, batch, run_id, seen_at, purge_skills=purge_skills))


def upsert_rows(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Batch rows replace target rows of the same key."""
    untouched = target.join(batch.select(key), key, "left_anti")
    return untouched.unionByName(batch.select(*target.columns))


def employers_of(batch: DataFrame, seq: str) -> DataFrame:
    """Employers named in a batch: those with an id and a name, last sighting wins."""
    named = batch.where("employer_id is not null and employer_id <> 0 and employer_name <> ''")
    rows = named.select("employer_id", F.col("employer_name").alias("name"),
                        F.col("employer_url").alias("url"), seq)
    return last_per_key(rows, "employer_id", seq)


def new_skills(known: DataFrame, batch: DataFrame, seq: str) -> DataFrame:
    """Skills not stored yet; the first spelling seen becomes the display name."""
    spelled = batch.select(seq, F.explode("raw_skills").alias("raw"))
    named = spelled.select(canonical_skill(F.col("raw")).alias("skill"), F.trim("raw").alias("raw"), seq)
    first = (named.where("skill <> ''").groupBy("skill").agg(F.min_by("raw", seq).alias("display_name")))
    return first.join(known.select("skill"), "skill", "left_anti")


def salary_rows(postings: DataFrame) -> DataFrame:
    """The 1:1 salary side table of the fact."""
    return postings.where("currency is not null").select(
        "posting_id", "amount_from", "amount_to", "currency", "gross", "from_net", "to_net", "estimate")


def upsert_salaries(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Side-table form: a re-seen posting without a salary loses its row."""
    untouched = target.join(batch.select("posting_id"), "posting_id", "left_anti")
    return untouched.unionByName(salary_rows(batch).select(*target.columns))


def rebuild_links(target: DataFrame, batch: DataFrame) -> DataFrame:
    """(posting_id, skill) bridge: postings with new skills lose their old links."""
    fresh = batch.select("posting_id", F.explode("skills").alias("skill")).distinct()
    untouched = target.join(fresh.select("posting_id"), "posting_id", "left_anti")
    return untouched.unionByName(fresh)
