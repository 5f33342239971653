import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import facts, one
from jobspectra.functions import text as txt
from jobspectra.functions.skilldict import ALIASES, by_priority, extract_skills
from jobspectra.operators import resume


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_clean_text(spark):
    df = frame(spark, "Hello  \t  world\n\n\n\nParagraph two\r\nLine", "  \n ", None, "x" * 60000)
    got = [r[0] for r in df.select(txt.clean_text(F.col("text"))).collect()]
    assert got == ["Hello world\n\nParagraph two\nLine", None, None, "x" * 60000]


@pytest.mark.parametrize("text, category, gone", [
    ("Контакт: developer@example.com для связи", "email", "developer@example.com"),
    ("Телефон: +7 (999) 123-45-67.", "phone", "123-45-67"), ("8(495)123-45-67", "phone", "123-45"),
    ("https://myportfolio.com/projects", "url", "myportfolio"), ("Telegram: @my_username", "social", "my_username"),
    ("Иванов Иван Иванович", "fio", "Иван"), ("Иван Петрович Сидоров", "fio", "Сидоров"),
    ("Дата рождения: 15.03.1990", "dob", "1990"), ("г. Москва, ул. Ленина, д. 15, кв. 42", "address", "кв. 42"),
    ("паспорт 4509 123456", "passport", "123456"), ("ИНН 7701234567", "inn", "7701234567"), ("СНИЛС 112-233-445 95", "snils", "445"),
])
def test_redaction(spark, text, category, gone):
    got = one(txt.redact(frame(spark, text), "text"))
    assert got.pii_categories[category] >= 1 and gone not in got.redacted_text and txt.PLACEHOLDER in got.redacted_text
    again = one(txt.redact(frame(spark, got.redacted_text), "text"))
    assert again.pii_total == 0 and again.redacted_text == got.redacted_text


def plain_redact(text):
    """The same stages written with the standard regex module."""
    total = {}
    for name, pattern in txt.PII_PATTERNS.items():
        text, n = re.subn(pattern, txt.PLACEHOLDER, text)
        total[name] = n

    def name_or_text(match):
        words = [w for w in match.groups() if w]
        if any(w in txt.NOT_NAMES for w in words):
            return match[0]
        patronymic = any(w.endswith(txt.PATRONYMIC_ENDINGS) for w in words)
        if patronymic or (len(words) == 2 and min(map(len, words)) >= txt.MIN_NAME_LENGTH):
            total["fio"] = total.get("fio", 0) + 1
            return txt.PLACEHOLDER
        return match[0]

    text = re.sub(txt.NAME_PATTERN, name_or_text, text)
    return text, {k: v for k, v in total.items() if v}


def test_redaction_agrees_with_the_plain_stages(spark):
    rng = random.Random(5)
    bits = ["https://a.io/me@x.com", "\ue000 b@c.io", "http://x.y/\ue000z", "[УДАЛЕНО]", "Иванов Иван", "Петрович", "Опыт Работы", "Ли На Ко", "Анна", "React", "a.b@c.io", "éa@b.com", "+7 999 123-45-67", "ул. Мира 5,", "@me_1",
            "www.x.ru/y?z", "112-233-445 95", "ИНН: 7701234567", "д.р. 1.2.1990", "\n", "слово", "Сидорова Мария Ильинична", "Telegram bob", "8 800 555 35 35"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    got = txt.redact(frame(spark, *texts), "text").orderBy("doc_id").collect()
    for row, source in zip(got, texts):
        want, counts = plain_redact(source)
        assert (row.redacted_text, dict(row.pii_categories), row.pii_total) == (want, counts, sum(counts.values())), source


def plain_skills(text):
    found = []
    for alias in by_priority():
        if ALIASES[alias] not in found and re.search(rf"\b{re.escape(alias)}\b", text.lower()):
            found.append(ALIASES[alias])
    return found


def test_skills(spark):
    rng = random.Random(3)
    fixed = ["reactjs, vuejs, nextjs и scss", "React и react и React.js", "Адаптивная вёрстка, кроссбраузерность", "", "react-native/css-in-js ci/cd",
             "unreact reactive next.json vue 3d", "react testing library"]
    joins = [" ", ", ", "-", "/", ".", "x", "ё", "\n"]
    texts = fixed + ["".join(rng.choice(list(ALIASES)) + rng.choice(joins) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    got = frame(spark, *texts).select("doc_id", extract_skills(F.col("text")).alias("s")).orderBy("doc_id").collect()
    assert [r.s for r in got] == [plain_skills(t) for t in texts]
    assert set(got[0].s) == {"React", "Vue.js", "Next.js", "CSS"} and got[1].s == ["React", "JavaScript"]


def test_match_and_score(spark):
    df = spark.createDataFrame([(["React"], ["react", "TypeScript"]), ([], ["a"]), (["a", "b"], [])], "resume_skills array<string>, market array<string>")
    got = resume.match_skills(df).collect()
    assert [(r.matched_skills, r.missing_skills, r.extra_skills, r.match_ratio) for r in got] == [
        (["react"], ["TypeScript"], [], .5), ([], ["a"], [], 0.0), ([], [], ["a", "b"], 0.0)]
    five = F.array(*[F.lit(str(i)) for i in range(5)])
    assert one(df.limit(1).select(resume.fit_score(F.lit(0.75), five)))[0] == 68


def test_analysis_end_to_end(spark):
    fact = facts(spark, *[{"skills": ["react", "css"], "grade_id": 1}] * 3, {"skills": ["git"], "grade_id": 3})
    docs = spark.createDataFrame([(1, "Иванов Иван Иванович, React", "junior"), (2, " \n", "junior"), (3, "nothing", None)],
                                 "doc_id long, text string, target_grade string")
    got = {r.doc_id: r for r in resume.analyze(docs, fact).collect()}
    assert set(got) == {1, 3}
    assert (got[1].matched_skills, got[1].missing_skills, got[1].match_ratio, got[1].market_sample_size) == (["react"], ["css"], .5, 4)
    assert got[1].market_fit_score == 38 and got[1].passes_keyword_filters and "Иванов" not in got[1].redacted_text
    assert got[3].advice_codes == ["add_missing", "low_coverage", "no_skills", "few_skills"] and "css" in got[3].recommendations[0]
    answers = spark.createDataFrame([(1, '```json\n{"market_fit_score": 80.4, "strengths": ["x"]}\n```'), (3, "sorry")], "doc_id long, answer string")
    merged = {r.doc_id: r for r in resume.apply_answers(resume.analyze(docs, fact), answers).collect()}
    assert (merged[1].market_fit_score, merged[1].strengths, merged[3].market_fit_score) == (80, ["x"], got[3].market_fit_score)


def test_bullets(spark):
    lines = ["- one", "• two", "* three", "1. four", "2) five", "plain", "10. six", "-", "- "] + ["- more"] * 9
    got = one(frame(spark, "\n".join(lines)).select(txt.bullets(F.col("text"))))[0]
    assert got[:5] == ["one", "two", "three", "four", "five"] and len(got) == 10 and "six" not in got


def test_dictionary_of_any_size(spark):
    from jobspectra.functions.lexicon import TERMS_PER_PASS, occurring
    terms = [f"term{i}x" for i in range(TERMS_PER_PASS + 40)] + ["term1x and more"]
    text = f"term1x and more, term{TERMS_PER_PASS + 30}x, noterm7x"
    df = spark.createDataFrame([(text,)], "t string").select(occurring(F.col("t"), terms, True).alias("hits"))
    assert df.first().hits == [1, TERMS_PER_PASS + 30, len(terms) - 1]


def test_documents_of_one_file_are_redacted_by_all_cores(spark, tmp_path):
    from jobspectra.plans.catalog.texts import _personal

    spark.sql("SELECT id AS doc_id, 'a' AS text FROM range(0, 50, 1, 1)").write.parquet(f"{tmp_path}/documents.parquet")
    found = _personal(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and found.count() == 50


def test_patterns_with_a_first_character_find_the_same(spark):
    pieces = ["@ab", "t.me/x", "TELEGRAM: ", "\u017fkype: ab", "vK.com/", "wa.me/z", "+7", "8", "999", "-12", "-34", " ", "(", "1", "\u0663", "é", "_", "İnstagram.com/q"]
    texts = [("".join(pieces[(i * k * k + 7 * k) % len(pieces)] for k in range(1, 14)),) for i in range(120)]
    df = spark.createDataFrame(texts, "t string")
    for name in ("social", "phone"):
        plain, quick = (F.regexp_extract_all("t", F.lit(x), F.lit(0)) for x in (txt._unicode(txt.PII_PATTERNS[name]), txt._unicode(txt.PII_PATTERNS[name], name)))
        assert all(r.a == r.b for r in df.select(plain.alias("a"), quick.alias("b")).collect())
