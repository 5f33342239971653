"""Scalar rules for the remaining posting fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobspectra.schema import GRADE_IDS

# --- fixed values: keywords, codes and stems the normalization rules compare with ----
GRADE_KEYWORDS = {
    "senior": ["senior", "sr", "сеньор", "синьор", "ведущий", "lead", "техлид",
               r"tech\s*lead", "принципал", "principal"],
    "middle": ["middle", "mid", "мидл", "мидлл"],
    "junior": ["junior", "jun", "джуниор", "джун", "младший", "стажер", "стажёр", "intern"],
}
EXPERIENCE_CODES = {"noexperience": "junior", "between1and3": "middle",
                    "between3and6": "senior", "morethan6": "senior"}
EXPERIENCE_PHRASES = {
    "нет опыта": "junior", "без опыта": "junior",
    "1–3": "middle", "от 1 до 3": "middle",
    "3–6": "senior", "от 3 до 6": "senior",
    "более 6": "senior", "6 и более": "senior",
}
WORK_FORMAT_WORDS = {
    "remote": ["удалён", "remote"],
    "hybrid": ["гибрид", "hybrid"],
    "office": ["офис", "office", "на месте"],
}
WORK_FORMAT_LABEL = "формат работы"
SCHEDULE_FORMATS = {"remote": "remote", "fullDay": "office", "flexible": "hybrid",
                    "shift": "office", "flyInFlyOut": "office"}
MONTH_STEMS = {"январ": 1, "феврал": 2, "март": 3, "апрел": 4, "мая": 5, "май": 5,
               "июн": 6, "июл": 7, "август": 8, "сентябр": 9, "октябр": 10,
               "ноябр": 11, "декабр": 12}
# -------------------------------------------------------------------------------------

UNKNOWN = "unknown"


def _first_match(text: Column, table: dict[str, str], start: Column | None = None):
    chain = start
    for needle, value in table.items():
        hit = text.contains(needle)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def keyword_grade(text: Column) -> Column:
    """Grade named in a text by whole words; the highest one wins."""
    chain = None
    for grade, words in GRADE_KEYWORDS.items():
        hit = text.rlike(rf"(?iU)\b(?:{'|'.join(words)})\b")
        chain = F.when(hit, grade) if chain is None else chain.when(hit, grade)
    return chain


def experience_grade(experience: Column) -> Column:
    text = F.lower(experience)
    squeezed = F.translate(text, " -", "")
    return F.coalesce(_first_match(squeezed, EXPERIENCE_CODES),
                      _first_match(text, EXPERIENCE_PHRASES))


def grade_code(title: Column, description: Column, experience: Column) -> Column:
    """Title keywords, then description keywords, then the experience field."""
    return F.coalesce(keyword_grade(title), keyword_grade(description),
                      experience_grade(experience), F.lit(UNKNOWN))


def grade_id(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in GRADE_IDS.items() for x in pair])
    return F.try_element_at(table, code)


def work_format(text: Column) -> Column:
    label_free = F.substring_index(F.lower(text), WORK_FORMAT_LABEL, -1)
    chain = None
    for name, words in WORK_FORMAT_WORDS.items():
        hit = label_free.rlike("|".join(words))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return F.coalesce(chain, F.lit(UNKNOWN))


def schedule_format(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SCHEDULE_FORMATS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit(UNKNOWN))


def id_after(url: Column, segment: str) -> Column:
    """Number that follows ``/segment/`` in a URL, else NULL."""
    return F.nullif(F.regexp_extract(url, rf"/{segment}/(\d+)", 1), F.lit("")).try_cast("long")


def canonical_skill(skill: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(skill, r"(?U)\s+", " ")))


def canonical_skills(skills: Column) -> Column:
    """Lower-cased, space-collapsed, first occurrence of each kept in order."""
    cleaned = F.transform(F.coalesce(skills, F.array().cast("array<string>")), canonical_skill)
    return F.array_distinct(F.filter(cleaned, lambda s: s != ""))


def _month_number(word: Column) -> Column:
    chain = None
    for stem, number in MONTH_STEMS.items():
        hit = word.startswith(stem)
        chain = F.when(hit, number) if chain is None else chain.when(hit, number)
    return chain


def _valid_day(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"),
                       F.lpad(day, 2, "0"))
    complete = month.isNotNull() & year.isNotNull() & (F.length(day) > 0)
    return F.when(complete, F.try_to_date(text, "yyyy-MM-dd")).cast("timestamp_ntz")


def russian_date(text: Column, current_year: Column) -> Column:
    """``5 июня 2026`` or ``5 июня`` (then ``current_year``) as midnight UTC."""
    lowered = F.lower(text)
    full = r"(?U)(\d{1,2})\s+(\w+)\s+(\d{4})"
    short = r"(?U)(\d{1,2})\s+(\w+)"
    part = lambda pattern, group: F.regexp_extract(lowered, pattern, group)
    dated = _valid_day(F.nullif(part(full, 3), F.lit("")), _month_number(part(full, 2)), part(full, 1))
    undated = _valid_day(current_year.cast("string"), _month_number(part(short, 2)), part(short, 1))
    return F.coalesce(dated, undated)


def iso_timestamp(text: Column) -> Column:
    """ISO date-time with ``Z`` or an offset as UTC TIMESTAMP_NTZ; bad text gives NULL."""
    shape = (r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?)"
             r"(Z|([+-])(\d{2}):?(\d{2}))?$")
    part = lambda group: F.regexp_extract(text, shape, group)
    wall = F.nullif(part(1), F.lit("")).try_cast("timestamp_ntz")
    minutes = (F.coalesce(part(4).try_cast("int"), F.lit(0)) * 60
               + F.coalesce(part(5).try_cast("int"), F.lit(0)))
    signed = F.when(part(3) == "-", -minutes).otherwise(minutes)
    return wall - F.make_dt_interval(mins=signed)
