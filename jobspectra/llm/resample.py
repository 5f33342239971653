"""Importance resampling of texts towards a target distribution of hashed word n-grams.

Features are all runs of one to ``n`` consecutive words, joined by one space; a feature's
bucket is the CRC-32 of its bytes modulo ``buckets``. A bucket's gain is the floored
thousandfold logarithm of its smoothed share in the target over that in the source; a
text's weight is the floored mean gain of its features. Gumbel noise from a digest of
the id turns weights into scores, so the highest scores are a weighted draw without
replacement that is the same on every run.

Length-bucketed CRC matrices: the distinct features of a block of texts are grouped by
their length in bytes, each group is a two-dimensional uint8 array, and one table look-up
per column moves all checksums of the group on by a byte. Buckets are then scattered back
to where the features stand. Words and pairs are told apart exactly, by their bytes. A
feature of more than ``LONGEST`` bytes is alone in its length more often than not and
goes to the library's CRC-32.

Texts are read twice, whole: for the counts (``buckets`` sums a task) and for the weights.
Ranks come from a sort over range partitions with counts as offsets; only a histogram of
scores (noise and gains are bounded, so it has a few thousand bins at most) and one count
a partition reach the driver.

Null and empty texts have no features and weight 0. A row without an id has no score and
is not drawn. Rows with equal score and id are ranked one after the other. An empty
target leaves every bucket the smoothed share.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobspectra.llm.shared import stored
from jobspectra.llm.words import Block, annotate, blocks, tabulate

BUCKETS = 10_000
LONGEST = 96
BIN = 100
#: Everything but digits, letters and bytes of other scripts stands between words.
_BETWEEN = np.array([not (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


#: One byte's effect on a checksum, from the polynomial.
TABLE = _crc_table()


def crc_columns(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a uint8 matrix, column by column."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = TABLE[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def _by_length(lens: np.ndarray):
    """(length, places) of each distinct length."""
    # Two-byte integers are sorted by counting.
    order = np.argsort(lens.astype(np.uint16) if not lens.size or lens.max() < 1 << 16 else lens, kind="stable")
    values, first = np.unique(lens[order], return_index=True)
    return zip(values.tolist(), np.split(order, first[1:]))


def word_ids(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal bytes only, and a word of each number."""
    ids = np.empty(len(block.starts), np.int64)
    firsts: list[np.ndarray] = []
    n = 0
    for length, places in _by_length(block.lens):
        if length > LONGEST:
            seen: dict[bytes, int] = {}
            raw = [block.data[s:s + length].tobytes() for s in block.starts[places].tolist()]
            key = np.array([seen.setdefault(r, len(seen)) for r in raw], np.int64)
        else:
            key = np.zeros(len(places), np.int64)
            for lo in range(0, length, 4):  # four bytes and the number so far make one integer
                piece = np.zeros((len(places), 4), np.uint8)
                part = block.starts[places][:, None] + np.arange(lo, min(lo + 4, length))
                piece[:, :part.shape[1]] = block.data[part]
                key = np.unique(key << 32 | piece.view("<u4")[:, 0].astype(np.int64), return_inverse=True)[1].astype(np.int64)
        _, first = np.unique(key, return_index=True)
        ids[places] = key + n
        firsts.append(places[first])
        n += len(first)
    return ids, np.concatenate(firsts) if firsts else np.zeros(0, np.int64)


def _checksums(block: Block, words: list[np.ndarray]) -> np.ndarray:
    """CRC-32 of features, each given by the places of its words, which stand in the text joined by one space."""
    total = sum(block.lens[w] for w in words) + len(words) - 1
    out = np.empty(len(total), np.uint32)
    for length, rows in _by_length(total):
        if length > LONGEST:
            for r in rows.tolist():
                out[r] = zlib.crc32(b" ".join(block.data[block.starts[w[r]]:block.starts[w[r]] + block.lens[w[r]]].tobytes() for w in words))
            continue
        for lo in range(0, len(rows), 65_536):
            some = rows[lo:lo + 65_536]
            matrix = np.full((len(some), length), 32, np.uint8)
            at = np.zeros(len(some), np.int64)
            for w in words:
                place, size = block.starts[w[some]], block.lens[w[some]]
                row = np.repeat(np.arange(len(some)), size)
                step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                matrix[row, at[row] + step] = block.data[place[row] + step]
                at += size + 1
            out[some] = crc_columns(matrix)
    return out


def features(block: Block, n: int = 2, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of a block, repeats included."""
    ids, first = word_ids(block)
    docs, found = [], []
    key, firsts = ids, [first]
    for size in range(1, n + 1):
        last = len(ids) - size + 1
        if last <= 0:
            break
        at = np.flatnonzero(block.doc[:last] == block.doc[size - 1:]) if size > 1 else np.arange(last)
        if size > 1:
            # A run is told by the number of its first words and the number of its last one.
            _, start, key = np.unique(key[at] * (len(first) + 1) + ids[at + size - 1], return_index=True, return_inverse=True)
            whole = np.full(len(ids), -1, np.int64)
            whole[at] = key
            firsts = [at[start] + k for k in range(size)]
            numbers, key = key, whole
        else:
            numbers = ids
        codes = (_checksums(block, firsts) % np.uint32(buckets)).astype(np.int64)
        docs.append(block.doc[at])
        found.append(codes[numbers])
    return (np.concatenate(docs), np.concatenate(found)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def counts(texts: DataFrame, text_col: str = "text", n: int = 2, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket. A task adds up its own texts, so it sends a row a bucket at most."""
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("features", T.LongType())])

    def add(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, block in blocks(batch.column(0).to_pylist(), True, _BETWEEN):
                total += np.bincount(features(block, n, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield {"bucket": at, "features": total[at]}

    rows = tabulate(texts.select(text_col), schema, add).groupBy("bucket").agg(F.sum("features").alias("features")).collect()
    out = np.zeros(buckets, np.int64)
    for row in rows:
        out[row["bucket"]] = row["features"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket, one added to every count."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text", n: int = 2) -> DataFrame:
    """Add n_words, n_features and weight (long) of every text."""

    def run(values: list) -> list[list]:
        out: list[list] = [[], [], []]
        for _, _, block in blocks(values, True, _BETWEEN):
            doc, bucket = features(block, n, len(gain))
            many = np.bincount(doc, minlength=block.n_docs).astype(np.int64)
            total = np.zeros(block.n_docs, np.int64)
            if len(doc):
                # Integer sums are exact.
                np.add.at(total, doc, gain[bucket])
            for held, more in zip(out, (block.n_words, many, total // np.maximum(many, 1))):
                held.extend(more.tolist())
        return out

    return annotate(docs, text_col, [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")], run)


def noise(id_col: str, seed: int) -> Column:
    """Gumbel noise of an id, floored thousandths."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), "UTF-8"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _ranked(scored: DataFrame, percent: int) -> DataFrame:
    """Add ``rank``: 1, 2, 3... of the drawn share of the eligible rows, null elsewhere."""
    bins = scored.where("eligible").groupBy(F.floor(F.col("score") / BIN).alias("bin")).count().collect()
    wanted = percent * sum(r["count"] for r in bins) // 100
    lowest, above = None, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        if above >= wanted:
            break
        lowest, above = r["bin"] * BIN, above + r["count"]
    near = F.col("eligible") & (F.col("score") >= F.lit(lowest)) if lowest is not None else F.lit(False)
    order = [F.desc("score"), F.col("doc_id"), F.col("at")]
    # Range partitions, each numbered in its order: the upper bits of the number are the partition.
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = scored.where(near).withColumn("at", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order) \
        .withColumn("at", F.monotonically_increasing_id())
    held = stored(held, "ranked")
    sizes = {r["part"]: r["count"] for r in held.groupBy(F.shiftright("at", 33).alias("part")).count().collect()}
    starts, total = [F.lit(-1), F.lit(0)], 0
    for part in sorted(sizes):
        starts += [F.lit(part), F.lit(total)]
        total += sizes[part]
    place = F.create_map(*starts)[F.shiftright("at", 33).cast("int")] + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    drawn = held.withColumn("rank", F.when(place <= wanted, place).cast("long")).drop("at")
    return drawn.unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
             n: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; ``percent`` of those with ``least_words`` words have a rank."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gain = gains(counts(texts, "text", n, buckets), counts(target, text_col, n, buckets))
    scored = weigh(texts, gain, "text", n).drop("text").withColumn("score", F.col("weight") + noise("doc_id", seed)) \
        .withColumn("eligible", (F.col("n_words") >= least_words) & F.col("score").isNotNull())
    return _ranked(stored(scored, "scored"), percent).select("doc_id", "n_features", "weight", "score", "rank")
