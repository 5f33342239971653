"""Registered queries of the operators: name -> (Spark callable, check SQL or None)."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobspectra.llm import ann, maintext, neardup, negatives, ngramlm, packing, pieces, pii, quality, resample, slices, tokenfile, toxicity
from jobspectra.session import shared_dir

_WORD = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(divisor: int, remainder: int):
    """Whether the checksum of the id, written in decimal, leaves this remainder."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % divisor == remainder


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the cascade for every document."""
    return quality.judge(documents(spark, sf_dir).select("doc_id", "text"), counts=True).drop("text")


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS words FROM d),
p AS (SELECT doc_id, generate_subscripts(words, 1) AS i, unnest(words) AS a FROM w),
g AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS k(k) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}')),
dups AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM lines GROUP BY doc_id),
f AS (SELECT d.doc_id, d.text, len(w.words) AS n_words,
        coalesce(list_sum(list_transform(w.words, lambda x: length(x))), 0) AS word_chars,
        len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS n_symbols,
        coalesce(dups.n_dup, 0) AS n_dup_lines, coalesce(dups.n_lines, 0) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words,
        len(regexp_extract_all(d.text, '\\p{{L}}')) AS n_letters, len(regexp_extract_all(d.text, '[A-Z]')) AS n_upper, len(regexp_extract_all(d.text, '[a-z]')) AS n_lower,
        len(regexp_extract_all(d.text, '!')) AS n_shouts,
        len(list_filter(w.words, lambda x: regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]'))) AS n_alpha,
        len(list_filter(string_split(d.text, chr(10)), lambda x: regexp_matches(x, '(\\.\\.\\.|…)[ \\t]*$'))) AS n_cut
      FROM d JOIN w USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 4 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR (n_upper > n_lower AND 2 * (n_upper + n_lower) > n_letters) OR 10 * n_alpha < 7 * n_words OR 2 * n_shouts > n_words OR 10 * n_cut > 5 * greatest(n_lines, 1)) AS kept
FROM b
"""

def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and survivor flag of every document, on four-word shingles."""
    return neardup.near_duplicates(documents(spark, sf_dir), k=4, percent=80)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence and the checksum of its ids."""
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page and its length in code points."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return maintext.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, end id included, and what they decode to, as digests."""
    return pieces.digests(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"), spans_col="found")
    base = pii.base_only(F.col("found"))
    return found.select("doc_id", *[pii.count(F.col("found"), k).alias(f"n_{k}") for k in pii.BASE_KINDS],
                        F.sha2(F.encode(pii.joined(base), "UTF-8"), 256).alias("base_sha256"), pii.joined(F.col("found")).alias("spans"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows found for each vector whose id is divisible by 100."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return ann.search(table, F.col("vec_id") % 100 == 0, ann.fit(table))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document; learned from ids whose checksum leaves a remainder by 5."""
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", held_out(5, 0))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(5, 0))
    model = toxicity.train(docs.where("NOT held_out"), labels)
    return toxicity.score(docs, model).drop("text")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram and base scores of every text, learned from ids whose checksum does not leave 2 by 7."""
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", held_out(7, 2))
    return ngramlm.score(docs, ngramlm.fit(docs.where("NOT held_out"))).drop("text")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids to coded files, read them back, and give place, length and checksum."""
    path = f"{shared_dir(spark)}/text-{uuid.uuid4().hex}/tokens"
    tokenfile.write(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every vector whose id is divisible by 100."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


_INTEGERS = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

OP11_SQL = f"""
WITH {_INTEGERS},
r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, q FROM v WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document against the benchmark's word pairs; a quarter is drawn."""
    return resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_FEATURE = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP12_SQL = f"""
WITH t AS (SELECT doc_id, text, 0 AS target FROM documents UNION ALL SELECT item_id, text, 1 FROM benchmark),
w AS (SELECT row_number() OVER () AS line, doc_id, target, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '{_FEATURE}') AS words FROM t),
f AS (SELECT line, target, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM w),
c AS (SELECT feature, list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(feature)) + 1), lambda i: CAST('0x' || hex(encode(feature))[2 * i - 1 : 2 * i] AS BIGINT))),
        lambda s, x: xor({resample.TABLE.tolist()}[CAST(xor(s, x) & 255 AS BIGINT) + 1], s >> 8)) AS state FROM (SELECT DISTINCT feature FROM f)),
b AS (SELECT feature, xor(state, 4294967295) % 10000 AS bucket FROM c),
n AS (SELECT bucket, CAST(count(*) FILTER (target = 0) AS DOUBLE) AS s, CAST(count(*) FILTER (target = 1) AS DOUBLE) AS t FROM f JOIN b USING (feature) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + 10000) / ((s + 1) * ((SELECT sum(t) FROM n) + 10000)))) AS BIGINT) AS gain FROM n),
m AS (SELECT line, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN b USING (feature) JOIN g USING (bucket) WHERE target = 0 GROUP BY line),
h AS (SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_features, CAST(coalesce(floor(total / CAST(n AS DOUBLE)), 0) AS BIGINT) AS weight,
        CAST('0x' || substr(sha256('7:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN m USING (line) WHERE target = 0),
d AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM h),
r AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place,
        count(*) FILTER (n_words >= 20) OVER () AS eligible FROM d)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= 25 * eligible // 100 THEN place END AS rank FROM r
"""


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows of highest integer inner product with each vector whose id is divisible by 50."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return slices.search(table, F.col("vec_id") % 50 == 0)


OP13_SQL = f"""
WITH {_INTEGERS},
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ENTRIES: dict[str, tuple] = {
    "op1_quality_rules": (op1_quality_rules, OP1_SQL),
    "op2_near_duplicates": (op2_near_duplicates, None),
    "op3_packing": (op3_packing, None),
    "op4_main_text": (op4_main_text, None),
    "op5_sentencepiece": (op5_sentencepiece, None),
    "op6_pii": (op6_pii, None),
    "op7_nearest": (op7_nearest, None),
    "op8_toxicity": (op8_toxicity, None),
    "op9_lm_scoring": (op9_lm_scoring, None),
    "op10_token_files": (op10_token_files, None),
    "op11_hard_negatives": (op11_hard_negatives, OP11_SQL),
    "op12_target_resampling": (op12_target_resampling, OP12_SQL),
    "op13_exact_top_k": (op13_exact_top_k, OP13_SQL),
}
