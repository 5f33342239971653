"""Free-text processing of whole documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobspectra.functions import text as txt
from jobspectra.functions.skilldict import ALIASES, by_priority, extract_skills
from jobspectra.operators import resume
from jobspectra.plans import bindings as b

ENTRIES: dict[str, tuple] = {}
GRADES = ["all", "junior", "middle", "senior"]
NAMES = ["Иванов Иван Иванович", "Иван Петрович Сидоров", "Опыт Работы", "Анна Смирнова", "Ли На", "Мария Ивановна"]


def add(name, fn, sql=None):
    ENTRIES[name] = (fn, sql)


def _resumes(s, d):
    """Every document with a few skill mentions and a target grade."""
    doc = F.col("doc_id")
    named = [b.choose(list(ALIASES), doc * m + a) for m, a in ((1, 0), (7, 3), (11, 40), (17, 90))]
    line = F.concat_ws(", ", *[F.when(doc % 6 == 0, F.upper(x)).otherwise(x) for x in named])
    return b.load(s, d, "documents").select(
        "doc_id", F.concat("text", F.lit("\r\n\n\n\nSkills:  "), line, F.lit(".")).alias("text"),
        b.choose(GRADES, doc).alias("target_grade"))


_MENTIONS = [b.sql_choose(list(ALIASES), f"doc_id * {m} + {a}") for m, a in ((1, 0), (7, 3), (11, 40), (17, 90))]
SQL_RESUMES = f"""rs AS (SELECT doc_id, text || E'\\r\\n\\n\\n\\nSkills:  ' ||
  concat_ws(', ', {', '.join(f"CASE WHEN doc_id % 6 = 0 THEN upper({x}) ELSE {x} END" for x in _MENTIONS)}) || '.' AS text,
  {b.sql_choose(GRADES, 'doc_id')} AS grade FROM documents)"""

# --- clean-up -------------------------------------------------------------------------
SQL_CLEAN = (r"""nullif(regexp_replace(regexp_replace(regexp_replace(replace({0}, E'\r\n', E'\n'), '\n{{3,}}', E'\n\n', 'g'),
  '[^\S\n]+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '')""")
add("clean_text",
    lambda s, d: (_resumes(s, d).select("doc_id", txt.clean_text(F.col("text")).alias("t"))
                  .select("doc_id", F.length("t").cast("long").alias("length"), F.md5(F.col("t").cast("binary")).alias("digest"))),
    f"""WITH {SQL_RESUMES}, c AS (SELECT doc_id, {SQL_CLEAN.format('text')} AS t FROM rs)
    SELECT doc_id, length(t) AS length, md5(t) AS digest FROM c""")

# --- personal data --------------------------------------------------------------------
_CATEGORIES = [*txt.PII_PATTERNS, txt.NAME_CATEGORY]


def _pii(s, d):
    redacted = txt.redact(b.load(s, d, "documents").select("doc_id", "text"), "text")
    count = lambda c: F.coalesce(F.try_element_at("pii_categories", F.lit(c)), F.lit(0)).cast("long")
    return redacted.select("doc_id", *[count(c).alias(c) for c in _CATEGORIES])


# The check engine's word boundary knows ASCII only. Where a pattern starts with a Cyrillic
# word, the character in front is matched and put back instead; the name pattern does without
# boundaries, as the texts hold no capitals inside words.
_LETTER = r"0-9A-Za-z_\x{00C0}-\x{024F}\x{0400}-\x{04FF}"
_CYRILLIC_START = ("dob", "passport", "inn")
_SQL_NAME = txt.NAME_PATTERN.replace(r"\b", "")
_SQL_IS_NAME = f"""NOT list_has_any(w, {b.sql_list(list(txt.NOT_NAMES))}) AND (
  len(list_filter(w, lambda v: regexp_matches(v, '(?:{'|'.join(txt.PATRONYMIC_ENDINGS)})$'))) > 0
  OR len(w) = 2 AND list_min(list_transform(w, lambda v: length(v))) >= {txt.MIN_NAME_LENGTH})"""


def _sql_redaction(source: str) -> str:
    """Tables that redact ``source`` (doc_id, text) stage by stage; the last, ``redacted``, has text and all counts."""
    stages, counted = [], []
    for name, raw in txt.PII_PATTERNS.items():
        pattern, kept = raw.replace("'", "''"), ""
        if name in _CYRILLIC_START:
            pattern, kept = f"(^|[^{_LETTER}])" + pattern.replace("(?i)\\b", "", 1), "\\1"
            pattern = "(?i)" + pattern
        stages.append(f"r_{name} AS (SELECT doc_id, {''.join(c + ', ' for c in counted)}coalesce(CAST(len(regexp_extract_all(text, '{pattern}')) "
                      f"AS BIGINT), 0) AS {name}, regexp_replace(text, '{pattern}', '{kept}{txt.PLACEHOLDER}', 'g') AS text FROM {source})")
        source = f"r_{name}"
        counted.append(name)
    columns = ", ".join(counted)
    stages.append(f"""r_words AS (SELECT doc_id, {columns}, text, regexp_extract_all(text, '{_SQL_NAME}') AS m FROM {source}),
    r_names AS (SELECT *, list_transform(m, lambda x: list_transform([string_split_regex(x, '\\s+')], lambda w: {_SQL_IS_NAME})[1]) AS hit FROM r_words),
    redacted AS (SELECT doc_id, {columns}, coalesce(CAST(len(list_filter(hit, lambda x: x)) AS BIGINT), 0) AS {txt.NAME_CATEGORY},
      array_to_string(list_transform(list_zip(string_split_regex(text, '{_SQL_NAME}'), m, hit),
        lambda x: x[1] || CASE WHEN x[3] THEN '{txt.PLACEHOLDER}' ELSE coalesce(x[2], '') END), '') AS text FROM r_names)""")
    return ",\n".join(stages)


add("pii_counts", _pii, f"WITH {_sql_redaction('documents')} SELECT doc_id, {', '.join(_CATEGORIES)} FROM redacted")


def _personal(s, d):
    """Documents followed by personal data of every category, written from the id."""
    doc = F.col("doc_id")
    number = F.lpad(doc.cast("string"), 7, "0")
    tail = F.concat(
        F.lit("\nИмя: "), b.choose(NAMES, doc), F.lit("; Дата рождения: 15.03.1990; паспорт 4509 "), F.substring(number, 2, 6),
        F.lit("; ИНН 77"), number, F.lit("1; СНИЛС 112-233-445 95; г. Москва, ул. Ленина, д. 15, кв. 42; Telegram: @user_"), number,
        F.lit("; https://site.example.com/u/"), number, F.lit("; +7 (999) 123-45-67; mail"), number, F.lit("@example.com"))
    return b.spread(b.load(s, d, "documents").select("doc_id", "text")).select("doc_id", F.concat("text", tail).alias("text"))


SQL_PERSONAL = f"""nb AS (SELECT doc_id, text, lpad(CAST(doc_id AS VARCHAR), 7, '0') AS number FROM documents),
  pe AS (SELECT doc_id, text || E'\\nИмя: ' || {b.sql_choose(NAMES, 'doc_id')} || '; Дата рождения: 15.03.1990; паспорт 4509 ' || substr(number, 2, 6)
    || '; ИНН 77' || number || '1; СНИЛС 112-233-445 95; г. Москва, ул. Ленина, д. 15, кв. 42; Telegram: @user_' || number
    || '; https://site.example.com/u/' || number || '; +7 (999) 123-45-67; mail' || number || '@example.com' AS text FROM nb)"""
_SQL_TOTAL = f"CAST({' + '.join(_CATEGORIES)} AS INTEGER)"
add("pii_redaction",
    lambda s, d: txt.redact(_personal(s, d), "text").select(
        "doc_id", F.length("redacted_text").alias("length"), F.md5(F.col("redacted_text").cast("binary")).alias("digest"), "pii_total",
        F.array_join(F.transform(F.map_entries("pii_categories"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
        .alias("categories")),
    f"""WITH {SQL_PERSONAL}, {_sql_redaction('pe')}
    SELECT doc_id, CAST(length(text) AS INTEGER) AS length, md5(text) AS digest, {_SQL_TOTAL} AS pii_total,
    concat_ws(',', {', '.join(f"CASE WHEN {c} > 0 THEN '{c}=' || {c} END" for c in _CATEGORIES)}) AS categories FROM redacted""")


def _names(s, d):
    """Only the name stage: the head of every conversation turn gets a Cyrillic phrase."""
    turns = b.load(s, d, "conversations").select(
        "conv_id", "turn", F.concat(b.choose(NAMES, F.col("conv_id") + F.col("turn")), F.lit(". "), "text").alias("text"))
    return txt.redact(turns, "text").select(
        "conv_id", "turn", F.coalesce(F.try_element_at("pii_categories", F.lit("fio")), F.lit(0)).cast("long").alias("names"))


add("name_redaction", _names,
    f"""SELECT conv_id, turn, CAST(({b.sql_list(['1', '1', '0', '1', '0', '1'])})[CAST((conv_id + turn) % 6 AS INT) + 1] AS BIGINT) AS names
    FROM conversations""")

# --- skills and market match ----------------------------------------------------------
_ORDERED = by_priority()


def _escape(alias: str) -> str:
    return "".join("\\" + c if c in ".+/-" else c for c in alias)


_FOUND = ", ".join(f"CASE WHEN regexp_matches(t, '{b.sql_bounded(_escape(a))}') THEN '{ALIASES[a]}' END" for a in _ORDERED)
SQL_FOUND = f"""lw AS (SELECT doc_id, grade, lower(text) AS t FROM rs),
  hs AS (SELECT doc_id, grade, list_filter([{_FOUND}], lambda x: x IS NOT NULL) AS l FROM lw),
  sks AS (SELECT doc_id, grade, {b.sql_distinct_in_order('l')} AS own FROM hs)"""
SQL_SKILLS = f"{SQL_RESUMES}, {SQL_FOUND}"
add("skill_extract",
    lambda s, d: _resumes(s, d).select("doc_id", F.array_join(extract_skills(F.col("text")), "|").alias("skills")),
    f"WITH {SQL_SKILLS} SELECT doc_id, array_to_string(own, '|') AS skills FROM sks")


def _market(s, d):
    """Postings whose skills are dictionary names, chosen from the keys of the order lines."""
    skill = b.choose(list(ALIASES.values()), F.col("l_partkey") % 31 * (F.col("l_suppkey") % 3 + 1))
    lists = (b.load(s, d, "lineitem").select(F.col("l_orderkey").alias("_id"), F.lower(skill).alias("skill"))
             .groupBy("_id").agg(F.collect_set("skill").alias("_skills")))
    base = b.postings(s, d)
    joined = base.join(lists, F.expr("posting_id = _id"), "left")
    return joined.selectExpr(*base.columns, "coalesce(_skills, CAST(array() AS array<string>)) AS skills")


SQL_MARKET = f"""mk AS (SELECT DISTINCT l_orderkey AS posting_id,
    lower({b.sql_choose(list(ALIASES.values()), 'l_partkey % 31 * (l_suppkey % 3 + 1)')}) AS skill FROM lineitem),
  mg AS (SELECT posting_id, skill, CASE {b.SQL_GRADE} WHEN 1 THEN 'junior' WHEN 2 THEN 'middle' WHEN 3 THEN 'senior' END AS grade
         FROM mk JOIN orders ON o_orderkey = posting_id),
  mc AS (SELECT grade, skill, count(*) AS c FROM mg WHERE grade IS NOT NULL GROUP BY 1, 2
         UNION ALL SELECT 'all', skill, count(*) FROM mg GROUP BY 2),
  mr AS (SELECT *, row_number() OVER (PARTITION BY grade ORDER BY c DESC, skill) AS r FROM mc),
  mt AS (SELECT grade, list(skill ORDER BY r) AS market FROM mr WHERE r <= 20 GROUP BY 1),
  jn AS (SELECT doc_id, sks.grade, own, market, list_transform(own, lambda x: lower(x)) AS lo FROM sks JOIN mt USING (grade)),
  mm AS (SELECT doc_id, grade, own, market, list_filter(market, lambda x: list_contains(lo, x)) AS matched,
         list_filter(market, lambda x: NOT list_contains(lo, x)) AS missing,
         list_filter(own, lambda x: NOT list_contains(market, lower(x))) AS extra FROM jn),
  mx AS (SELECT *, round(len(matched) / len(market)::DOUBLE, 2) AS ratio FROM mm),
  fs AS (SELECT *, ratio * 70 + least(len(own) / 10.0::DOUBLE, 1.0::DOUBLE) * 30 AS raw FROM mx)"""
_JOINED = lambda c: F.array_join(c, "|").alias(c)
add("resume_match",
    lambda s, d: resume.analyze(_resumes(s, d), _market(s, d)).select(
        "doc_id", "target_grade", *[_JOINED(c) for c in ("resume_skills", "matched_skills", "missing_skills", "extra_skills")],
        "match_ratio", "market_fit_score", "passes_keyword_filters", _JOINED("advice_codes"), "market_sample_size"),
    f"""WITH {SQL_SKILLS}, {SQL_MARKET}
    SELECT doc_id, grade AS target_grade, array_to_string(own, '|') AS resume_skills, array_to_string(matched, '|') AS matched_skills,
    array_to_string(missing, '|') AS missing_skills, array_to_string(extra, '|') AS extra_skills, ratio AS match_ratio,
    CAST(round_even(raw, 0) AS INTEGER) AS market_fit_score, ratio >= 0.3 AS passes_keyword_filters,
    CASE WHEN len(missing) = 0 AND ratio >= 0.5 AND len(own) >= 5 THEN 'good_match' ELSE concat_ws('|',
      CASE WHEN len(missing) > 0 THEN 'add_missing' END,
      CASE WHEN ratio < 0.3 THEN 'low_coverage' WHEN ratio < 0.5 THEN 'moderate_coverage' END,
      CASE WHEN len(own) = 0 THEN 'no_skills' END, CASE WHEN len(own) < 5 THEN 'few_skills' END) END AS advice_codes,
    (SELECT count(*) FROM orders) AS market_sample_size FROM fs""")
_advice = lambda code: "'" + resume.ADVICE[code].replace("'", "''") + "'"
add("resume_analysis",
    lambda s, d: resume.analyze(_personal(s, d).withColumn("target_grade", F.lit("middle")), _market(s, d)).select(
        "doc_id", F.length("redacted_text").alias("length"), "pii_total", "market_fit_score", _JOINED("recommendations")),
    f"""WITH {SQL_PERSONAL}, rs AS (SELECT doc_id, text, 'middle' AS grade FROM pe), {SQL_FOUND}, {SQL_MARKET},
    cl AS (SELECT doc_id, {SQL_CLEAN.format('text')} AS text FROM pe WHERE text IS NOT NULL),
    {_sql_redaction('cl')}
    SELECT doc_id, CAST(length(text) AS INTEGER) AS length, {_SQL_TOTAL} AS pii_total, CAST(round_even(raw, 0) AS INTEGER) AS market_fit_score,
    CASE WHEN len(missing) = 0 AND ratio >= 0.5 AND len(own) >= 5 THEN {_advice('good_match')} ELSE concat_ws('|',
      CASE WHEN len(missing) > 0 THEN replace({_advice('add_missing')}, '{{skills}}', array_to_string(missing[1:5], ', ')) END,
      CASE WHEN ratio < 0.3 THEN {_advice('low_coverage')} WHEN ratio < 0.5 THEN {_advice('moderate_coverage')} END,
      CASE WHEN len(own) = 0 THEN {_advice('no_skills')} END, CASE WHEN len(own) < 5 THEN {_advice('few_skills')} END) END AS recommendations
    FROM redacted JOIN fs USING (doc_id)""")

# --- bullets and answers --------------------------------------------------------------
MARKERS = ["- ", "• ", "* ", "1. ", "2) ", "", "-- ", "10. "]


def _marked(s, d):
    at = F.col("conv_id") + F.col("turn")
    return b.load(s, d, "conversations").select("conv_id", "turn", F.concat(
        F.lit("Intro\n  "), b.choose(MARKERS, at), F.replace("text", F.lit(". "), F.concat(F.lit("\n"), b.choose(MARKERS, at + 1))),
        F.lit("\n"), b.choose(MARKERS, at + 2), F.lit("last")).alias("text"))


def _sql_marker(shift: int) -> str:
    return b.sql_choose(MARKERS, f"conv_id + turn + {shift}")


add("bullets",
    lambda s, d: _marked(s, d).select("conv_id", "turn", F.array_join(txt.bullets(F.col("text")), "|").alias("bullets")),
    rf"""WITH x AS (SELECT conv_id, turn, E'Intro\n  ' || {_sql_marker(0)} || replace(text, '. ', E'\n' || {_sql_marker(1)}) || E'\n' ||
      {_sql_marker(2)} || 'last' AS text FROM conversations),
    y AS (SELECT conv_id, turn, list_transform(string_split(text, E'\n'), lambda v: trim(v, E' \t\r\n')) AS l FROM x),
    z AS (SELECT conv_id, turn, list_filter(list_transform(list_filter(l, lambda v: regexp_matches(v, '^(- |• |\* |[0-9][.)].)')),
      lambda v: trim(regexp_replace(v, '^[-•* 0-9.)]+', ''))), lambda v: v <> '') AS l FROM y)
    SELECT conv_id, turn, array_to_string(l[1:10], '|') AS bullets FROM z""")


def _answers(s, d):
    """External answers written from the labels: clean, fenced, wrapped, broken, odd types."""
    doc = F.col("doc_id")
    score = doc % 120
    plain = F.concat(F.lit('{"market_fit_score": '), score.cast("string"), F.lit(', "estimated_grade": "middle", "salary_range": {"from": '),
                     (doc * 1000).cast("string"), F.lit(', "to": 5}, "passes_keyword_filters": true, "strengths": ["a", "b"], '),
                     F.lit('"weaknesses": "none", "recommendations": ["learn"]}'))
    text = (F.when(doc % 5 == 0, plain).when(doc % 5 == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
            .when(doc % 5 == 2, F.concat(F.lit("Result: "), plain, F.lit(" done"))).when(doc % 5 == 3, F.lit("no answer {"))
            .otherwise(F.lit('{"market_fit_score": "80", "salary_range": [1]}')))
    return b.load(s, d, "labels").select("doc_id", text.alias("answer"))


def _merged_answers(s, d):
    rules = b.load(s, d, "documents").select(
        "doc_id", F.lit(10).alias("market_fit_score"), F.lit(False).alias("passes_keyword_filters"),
        F.array(F.lit("rule")).alias("recommendations"))
    merged = resume.apply_answers(rules, _answers(s, d))
    return merged.select("doc_id", "market_fit_score", "passes_keyword_filters", _JOINED("recommendations"), "estimated_grade",
                         F.col("salary_range.from").alias("salary_from"), F.col("salary_range.to").alias("salary_to"),
                         _JOINED("strengths"), F.size("weaknesses").alias("weaknesses"), "answer_used")


add("answers_merge", _merged_answers,
    """WITH a AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS answered, coalesce(l.doc_id % 5 < 3, false) AS good
      FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT doc_id, CAST(CASE WHEN good AND doc_id % 120 <= 100 THEN doc_id % 120 ELSE 10 END AS INTEGER) AS market_fit_score,
    good AS passes_keyword_filters, CASE WHEN good THEN 'learn' ELSE 'rule' END AS recommendations,
    CASE WHEN good THEN 'middle' END AS estimated_grade, CASE WHEN good THEN CAST(doc_id * 1000 AS DOUBLE) END AS salary_from,
    CASE WHEN good THEN 5.0::DOUBLE END AS salary_to, CASE WHEN good THEN 'a|b' ELSE '' END AS strengths, 0 AS weaknesses,
    answered AS answer_used FROM a""")
