"""Free-text rules: clean-up, personal-data redaction, bullets and answer salvage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: placeholder, patterns in order of application, name rules ----------
PLACEHOLDER = "[УДАЛЕНО]"
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "url": r"(?i)https?://[^\s<>\"']+|www\.[^\s<>\"']+",
    "social": (r"(?i)(?:@[A-Za-z0-9_]{2,30})"
               r"|(?:(?:t\.me|telegram\.me|vk\.com|facebook\.com|linkedin\.com|github\.com"
               r"|instagram\.com|twitter\.com|wa\.me)/[^\s<>\"']+)"
               r"|(?:(?:skype|telegram|whatsapp|viber)[\s:]+[A-Za-z0-9_.@\-]+)"),
    "phone": (r"(?:(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2})"
              r"|(?:\+\d{1,3}[\s\-]?\(?\d{2,4}\)?[\s\-]?\d{3,4}[\s\-]?\d{2,4})"
              r"|(?:\b\d[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}\b)"),
    "dob": (r"(?i)\b(?:дата\s+рождения|д\.?\s*р\.?|родил(?:ся|ась)|born)[\s:]*"
            r"(\d{1,2}[\s./\-]\d{1,2}[\s./\-]\d{2,4})"),
    "passport": r"(?i)\b(?:паспорт|passport)[\s:]*\d{2}\s*\d{2}\s*\d{6}\b",
    "inn": r"(?i)\b(?:ИНН|INN)[\s:]*\d{10,12}\b",
    "snils": r"\b\d{3}[\s\-]?\d{3}[\s\-]?\d{3}[\s\-]?\d{2}\b",
    "address": (r"(?i)(?:г\.\s*[А-ЯЁа-яё]+|ул\.\s*[А-ЯЁа-яё\s]+|пр\.\s*[А-ЯЁа-яё\s]+|"
                r"д\.\s*\d+|кв\.\s*\d+|корп\.\s*\d+|стр\.\s*\d+|"
                r"пос\.\s*[А-ЯЁа-яё]+|обл\.\s*[А-ЯЁа-яё]+)"),
}
NAME_PATTERN = r"\b([А-ЯЁ][а-яё]{1,20})\s+([А-ЯЁ][а-яё]{1,20})(?:\s+([А-ЯЁ][а-яё]{1,20}))?\b"
PATRONYMIC_ENDINGS = ("вич", "вна", "ич", "на")
NOT_NAMES = (
    "Опыт", "Работы", "Образование", "Навыки", "Проекты", "Языки",
    "Контакты", "Резюме", "Компания", "Должность", "Период",
    "Описание", "Достижения", "Сертификаты", "Курсы",
    "Ожидаемая", "Зарплата", "Город", "Возраст",
    "Junior", "Middle", "Senior", "Frontend", "Backend", "Fullstack",
    "React", "Angular", "Python", "JavaScript", "TypeScript",
    "Разработчик", "Программист", "Инженер", "Менеджер",
    "Высшее", "Среднее",
)
MIN_NAME_LENGTH = 3
MAX_BULLETS = 10
# -------------------------------------------------------------------------------------

NAME_CATEGORY = "fio"
_MARK = "\ue000"


# What every match starts with, for patterns of many alternatives: one character class
# refuses most places at once. Others are no faster with it.
_STARTS = {"social": "[@tvflgiws]", "phone": r"[+\d]"}


def _unicode(pattern: str, category: str | None = None) -> str:
    flags, rest = ("(?iU)", pattern[4:]) if pattern.startswith("(?i)") else ("(?U)", pattern)
    return f"{flags}(?={_STARTS[category]})(?:{rest})" if category in _STARTS else flags + rest


def clean_text(text: Column) -> Column:
    """Unix line ends, at most one blank line, single spaces, trimmed; blank gives NULL."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    lines = F.regexp_replace(unix, r"\n{3,}", "\n\n")
    # Runs of blanks and single odd blanks; a lone plain space stays as it is.
    spaced = F.regexp_replace(lines, r"(?U)[^\S\n]{2,}|[\s&&[^\n ]]", " ")
    return F.nullif(F.btrim(spaced, F.lit(" \n")), F.lit(""))


def has_text(text: Column) -> Column:
    """Whether ``clean_text`` would leave anything; stops at the first visible character."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def _likely_name(match: Column) -> Column:
    words = F.split(match, r"(?U)\s+")
    excluded = F.exists(words, lambda w: w.isin(*NOT_NAMES))
    patronymic = F.exists(words, lambda w: w.rlike(f"(?:{'|'.join(PATRONYMIC_ENDINGS)})$"))
    plain_pair = (F.size(words) == 2) & F.forall(words, lambda w: F.length(w) >= MIN_NAME_LENGTH)
    return ~excluded & (patronymic | plain_pair)


# What a text must hold for a category to match at all. These signs cost a plain search
# each and spare most texts the case-insensitive patterns; they never exclude a match.
_SIGNS = ("_cyrillic", "_digits", "_web", "_network", "_born", "_passport", "_inn")
_POSSIBLE = {
    "email": "contains(_t, '@')", "url": "_web", "social": "_network OR contains(_t, '@')", "phone": "_digits",
    "dob": "_digits AND (_cyrillic OR _born)", "passport": "_digits AND (_cyrillic OR _passport)",
    "inn": "_digits AND (_cyrillic OR _inn)", "snils": "_digits", "address": "_cyrillic",
}


def _with_signs(df: DataFrame, kept: list[Column]) -> DataFrame:
    # Upper then lower case maps every letter the case-insensitive match treats as equal
    # to the same one (the long s and the dotless i included).
    folded = df.select(*kept, "_t", F.lower(F.upper("_t")).alias("_f"))
    any_of = lambda *words: " OR ".join(f"contains(_f, '{w}')" for w in words)
    signs = {
        "_cyrillic": r"_t RLIKE '[\\u0400-\\u04FF]'", "_digits": r"_t RLIKE '(?U)\\d\\d'",
        "_web": any_of("http", "www."), "_network": any_of(".me/", ".com/", "skype", "telegram", "whatsapp", "viber"),
        "_born": any_of("born"), "_passport": any_of("passport"), "_inn": any_of("inn"),
    }
    return folded.select(*kept, "_t", *[F.expr(e).alias(n) for n, e in signs.items()])


def redact(df: DataFrame, text: str, *, redacted: str = "redacted_text",
           categories: str = "pii_categories", total: str = "pii_total") -> DataFrame:
    """Replaces personal data category by category and counts every replacement.

    Each stage sees the text the previous ones left. Matches are found left to right
    without overlap, and a declined name candidate is consumed like an accepted one.
    """
    kept = [F.col(c) for c in df.columns]
    stage = _with_signs(df.select(*kept, F.col(text).alias("_t")), kept)
    counted: list[str] = []
    for category, raw in PII_PATTERNS.items():
        pattern, possible = _unicode(raw, category), F.expr(_POSSIBLE[category])
        # One pass marks the matches and the marks are counted. A text that holds the
        # mark character itself is counted and replaced by the pattern directly.
        marked = stage.select(
            *kept, *counted, *_SIGNS, "_t",
            F.when(~possible, F.lit(None)).when(F.col("_t").contains(_MARK), F.lit(None))
            .otherwise(F.regexp_replace("_t", pattern, _MARK)).alias("_m"),
            (possible & F.col("_t").contains(_MARK)).alias("_plain"))
        marks = F.length("_m") - F.length(F.replace("_m", F.lit(_MARK), F.lit("")))
        stage = marked.select(
            *kept, *counted, *_SIGNS,
            F.when(F.col("_plain"), F.regexp_count("_t", F.lit(pattern))).otherwise(F.coalesce(marks, F.lit(0)))
            .alias(f"_n_{category}"),
            F.when(F.col("_plain"), F.regexp_replace("_t", pattern, PLACEHOLDER))
            .otherwise(F.coalesce(F.replace("_m", F.lit(_MARK), F.lit(PLACEHOLDER)), "_t")).alias("_t"))
        counted.append(f"_n_{category}")

    name = _unicode(NAME_PATTERN)
    stage = stage.select(*kept, *counted, "_t",
                         F.when(F.col("_cyrillic"), F.regexp_extract_all("_t", F.lit(name), 0))
                         .otherwise(F.array().cast("array<string>")).alias("_names"))
    stage = stage.select(*kept, *counted, "_t", "_names",
                         F.transform("_names", _likely_name).alias("_is_name"))
    rebuilt = F.array_join(
        F.zip_with(F.split("_t", name, -1),
                   F.zip_with("_names", "_is_name",
                              lambda m, hit: F.when(hit, PLACEHOLDER).otherwise(m)),
                   lambda between, match: F.concat(between, F.coalesce(match, F.lit("")))), "")
    names_found = F.size(F.filter("_is_name", lambda hit: hit))
    stage = stage.select(
        *kept, *counted, names_found.alias(f"_n_{NAME_CATEGORY}"),
        F.when(names_found > 0, rebuilt).otherwise(F.col("_t")).alias(redacted))
    order = [*PII_PATTERNS, NAME_CATEGORY]
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"_n_{c}").alias("v")) for c in order])
    amount = sum((F.coalesce(F.col(f"_n_{c}"), F.lit(0)) for c in order), F.lit(0))
    return stage.select(
        *kept, redacted,
        F.map_from_entries(F.filter(pairs, lambda p: p["v"] > 0)).alias(categories),
        amount.alias(total))


def bullets(text: Column) -> Column:
    """The first bullet or numbered lines of a text without their markers."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", ""))
    marked = F.filter(lines, lambda x: x.rlike(r"(?Us)^(?:[-•*] |\d[.)].)"))
    bare = F.transform(marked, lambda x: F.regexp_replace(x, r"^[-•* 0-9.)]+", ""))
    kept = F.filter(bare, lambda x: x != "")
    return F.slice(F.transform(kept, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")), 1, MAX_BULLETS)


def salvage_json(text: Column) -> Column:
    """VARIANT parsed from generated text: fence removed, else the outermost braces."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")
    inner = F.regexp_replace(trimmed, r"(?s)\A```[^\n]*\n(.*)\n[^\n]*\z", "$1")
    unfenced = F.when(trimmed.startswith("```"), inner).otherwise(trimmed)
    braces = F.regexp_extract(unfenced, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(unfenced), F.try_parse_json(braces))
