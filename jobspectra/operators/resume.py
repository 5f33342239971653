"""Batch comparison of free-text documents with the market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobspectra.functions import text as txt
from jobspectra.functions.skilldict import extract_skills
from jobspectra.operators import metrics as m
from jobspectra.operators.metrics import Slice
from jobspectra.schema import GRADE_IDS, TOP_N

# --- fixed values: scoring weights, limits and recommendation texts --------------------
RATIO_POINTS = 70
SKILL_POINTS = 30
FULL_SKILL_COUNT = 10
KEYWORD_RATIO = 0.3
MODERATE_RATIO = 0.5
FEW_SKILLS = 5
MAX_ADVICE = 5
ADVICE = {
    "add_missing": ("Добавьте в резюме опыт работы с: {skills}. "
                    "Эти навыки наиболее востребованы на рынке."),
    "low_coverage": ("Ваше покрытие ключевых рыночных навыков ниже 30%. Рекомендуется расширить стек "
                     "технологий или более подробно описать имеющийся опыт."),
    "moderate_coverage": ("Покрытие рыночных навыков умеренное. Для повышения шансов стоит добавить "
                          "недостающие ключевые технологии."),
    "no_skills": ("В резюме не найдены технические навыки. Укажите конкретные технологии, фреймворки "
                  "и инструменты."),
    "few_skills": ("В резюме указано мало навыков. Перечислите все технологии, с которыми работали "
                   "(React, TypeScript, Git и т.д.)."),
    "good_match": ("Профиль навыков хорошо соответствует рынку. Для дальнейшего роста обратите внимание "
                   "на углубление специализации."),
}
# -------------------------------------------------------------------------------------


def market_skills(postings: DataFrame, n: int = TOP_N) -> DataFrame:
    """(grade, market): the ordered top skills of the whole market and of each grade."""
    graded = postings.where("grade_id is not null")
    ranking = m.top_skills_by(graded, "grade_id", n=n).select("grade_id", "rank", "skill")
    whole = m.top_skills_by(postings.withColumn("grade_id", F.lit(0)), "grade_id", n=n).select(
        "grade_id", "rank", "skill")
    packed = (ranking.unionByName(whole).groupBy("grade_id")
              .agg(F.array_sort(F.collect_list(F.struct("rank", "skill"))).alias("l")))
    code = F.when(F.col("grade_id") == 0, "all")
    for name, grade_id in GRADE_IDS.items():
        code = code.when(F.col("grade_id") == grade_id, name)
    return packed.select(code.alias("grade"), F.transform("l", lambda x: x["skill"]).alias("market"))


def match_skills(df: DataFrame, own: str = "resume_skills", market: str = "market") -> DataFrame:
    """Adds matched and missing (market order), extra skills and the match ratio."""
    lowered = lambda c: F.transform(c, lambda s: F.lower(s))
    kept = [F.col(c) for c in df.columns]
    low = df.select(*kept, lowered(own).alias("_own"), lowered(market).alias("_market"))
    matched = F.filter(market, lambda s: F.array_contains("_own", F.lower(s)))
    ratio = F.when(F.size(market) > 0, F.bround(F.size("matched_skills") / F.size(market), 2)).otherwise(F.lit(0.0))
    out = low.select(
        *kept, matched.alias("matched_skills"),
        F.filter(market, lambda s: ~F.array_contains("_own", F.lower(s))).alias("missing_skills"),
        F.filter(own, lambda s: ~F.array_contains("_market", F.lower(s))).alias("extra_skills"))
    return out.select("*", ratio.alias("match_ratio"))


def fit_score(ratio: Column, skills: Column) -> Column:
    counted = F.least(F.size(skills) / F.lit(float(FULL_SKILL_COUNT)), F.lit(1.0)) * SKILL_POINTS
    return F.bround(ratio * RATIO_POINTS + counted, 0).cast("int")


def advice_codes(ratio: Column, skills: Column, missing: Column) -> Column:
    count = F.size(skills)
    codes = F.array_compact(F.array(
        F.when(F.size(missing) > 0, "add_missing"),
        F.when(ratio < KEYWORD_RATIO, "low_coverage").when(ratio < MODERATE_RATIO, "moderate_coverage"),
        F.when(count == 0, "no_skills"),
        F.when(count < FEW_SKILLS, "few_skills")))
    return F.slice(F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("good_match"))), 1, MAX_ADVICE)


def advice_texts(codes: Column, missing: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    named = F.array_join(F.slice(missing, 1, FEW_SKILLS), ", ")
    return F.transform(codes, lambda c: F.replace(F.element_at(table, c), F.lit("{skills}"), named))


def analyze(documents: DataFrame, postings: DataFrame, *, n: int = TOP_N) -> DataFrame:
    """Clean, redact, extract, match, score and advise; blank documents are left out.

    ``documents`` is (doc_id, text, target_grade). The market side is at most one short
    row per grade, hence the broadcast.
    """
    filled = documents.where(txt.has_text(F.col("text")))
    clean = filled.select("doc_id", F.coalesce("target_grade", F.lit("all")).alias("grade"),
                          txt.clean_text(F.col("text")).alias("text"))
    found = clean.select("*", extract_skills(F.col("text")).alias("resume_skills"))
    safe = txt.redact(found, "text")
    joined = safe.join(F.broadcast(market_skills(postings, n)), "grade", "left").withColumn(
        "market", F.coalesce("market", F.array().cast("array<string>")))
    matched = match_skills(joined)
    codes = advice_codes(F.col("match_ratio"), F.col("resume_skills"), F.col("missing_skills"))
    return matched.select(
        "doc_id", F.col("grade").alias("target_grade"), "redacted_text", "pii_categories", "pii_total",
        "resume_skills", "matched_skills", "missing_skills", "extra_skills", "match_ratio",
        fit_score(F.col("match_ratio"), F.col("resume_skills")).alias("market_fit_score"),
        (F.col("match_ratio") >= KEYWORD_RATIO).alias("passes_keyword_filters"),
        codes.alias("advice_codes"), advice_texts(codes, F.col("missing_skills")).alias("recommendations"),
        m.total_count(postings).alias("market_sample_size"))


def apply_answers(results: DataFrame, answers: DataFrame) -> DataFrame:
    """Overrides rule results with parsed external answers (doc_id, answer text).

    A score counts only when it is a number in 0..100, lists only when lists, a salary
    range only when an object; anything else keeps the rule value.
    """
    parsed = answers.select("doc_id", txt.salvage_json(F.col("answer")).alias("v"))
    kind = lambda p: F.schema_of_variant(F.try_variant_get("v", p, "variant"))
    score = F.when(kind("$.market_fit_score").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"),
                   F.try_variant_get("v", "$.market_fit_score", "double"))
    texts = lambda p: F.when(kind(p).startswith("ARRAY"), F.try_variant_get("v", p, "array<string>"))
    grade = F.try_variant_get("v", "$.estimated_grade", "string")
    span = F.when(kind("$.salary_range").startswith("OBJECT"), F.struct(
        F.try_variant_get("v", "$.salary_range.from", "double").alias("from"),
        F.try_variant_get("v", "$.salary_range.to", "double").alias("to")))
    read = parsed.select(
        "doc_id", F.when(score.between(0, 100), F.bround(score, 0).cast("int")).alias("_score"),
        grade.alias("estimated_grade"), span.alias("salary_range"),
        F.try_variant_get("v", "$.passes_keyword_filters", "boolean").alias("_passes"),
        texts("$.strengths").alias("strengths"), texts("$.weaknesses").alias("weaknesses"),
        texts("$.recommendations").alias("_advice"), F.lit(True).alias("_answered"))
    none = F.array().cast("array<string>")
    replaced = {"market_fit_score": F.coalesce("_score", "market_fit_score"),
                "passes_keyword_filters": F.coalesce("_passes", "passes_keyword_filters"),
                "recommendations": F.coalesce("_advice", "recommendations")}
    joined = results.join(read, "doc_id", "left")
    return joined.select(
        *[replaced.get(c, F.col(c)).alias(c) for c in results.columns], "estimated_grade", "salary_range",
        F.coalesce("strengths", none).alias("strengths"), F.coalesce("weaknesses", none).alias("weaknesses"),
        F.coalesce("_answered", F.lit(False)).alias("answer_used"))
