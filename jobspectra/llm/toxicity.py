"""Toxicity scores from confirmed toxic examples and unlabelled text (non-negative PU learning).

Features are the distinct letter runs of a text, whole and as prefixes of 4 to 7 bytes,
hashed to 32 bits. A linear model is trained in numpy on the class-prior-corrected
risk  pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)]):  toxic examples stand for P, any
texts for U, and pi is the share of toxic rows among the labelled ones. Where the
estimated negative part falls below zero, its gradient is turned round, which keeps the
model from paying for examples it has merely memorized. A soft threshold drops weak weights.

Copies among the examples are left out of the fit. It takes at most ``MAX_TOXIC`` toxic and ``MAX_UNLABELLED`` other texts, chosen by a
hash of the id, so what comes to the driver is bounded. Scoring is one pass over whole
texts without a shuffle. Null and empty texts have no features and get the score of the
bias alone. Without any toxic example every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobspectra.llm.words import Block, annotate, blocks, hand_back, mix, tabulate

MAX_TOXIC = 2_000
MAX_UNLABELLED = 6_000
#: Least standard errors between the two rates of a feature, least toxic share of its texts, least toxic examples.
MIN_Z, MIN_SHARE, MIN_TEXTS = 5.0, 0.7, 4
#: Least share of the toxic examples that have a feature.
MIN_TOXIC_SHARE = 0.01
PREFIXES = (4, 5, 6, 7)
_BETWEEN = np.ones(256, bool)
_BETWEEN[[b for b in range(256) if b >= 128 or chr(b).isalpha()]] = False


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) of every word and prefix, repeats included."""
    whole = block.hashes()
    found, where = [whole], [block.doc]
    for n in PREFIXES:
        longer = block.lens >= n
        # A prefix is another feature than the word of the same letters.
        found.append(block.prefix_hashes(n)[longer] * np.uint64(2 * n + 1))
        where.append(block.doc[longer])
    return np.concatenate(where), (np.concatenate(found) >> np.uint64(32)).astype(np.int64)


@dataclass
class Model:
    """Non-zero weights of features in ascending order, and the bias."""

    known: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        possible = np.zeros(1 << 20, bool)
        possible[self.known >> 12] = True
        out = np.full(len(texts), self.bias)
        for lo, hi, block in blocks([None if t is None else t.lower() for t in texts], False, _BETWEEN):
            doc, feature = features(block)
            near = possible[feature >> 12]
            once = np.unique((doc[near] << 32) | feature[near])
            at = np.searchsorted(self.known, once & 0xFFFF_FFFF)
            hit = at < len(self.known)
            hit[hit] = self.known[at[hit]] == (once[hit] & 0xFFFF_FFFF)
            out[lo:hi] += np.bincount(once[hit] >> 32, self.weights[at[hit]], minlength=hi - lo)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def originals(rows: list[np.ndarray]) -> np.ndarray:
    """False for rows that look like copies of an earlier one: one of six bands of six
    min-hash values was there before. Copies would make the words of one text look telling."""
    seeds = mix(np.arange(1, 37, dtype=np.uint64)) | np.uint64(1)
    before: set[tuple[int, bytes]] = set()
    out = np.ones(len(rows), bool)
    for i, r in enumerate(rows):
        if len(r):
            least = np.full(36, np.iinfo(np.uint64).max, np.uint64)
            for lo in range(0, len(r), 2048):
                np.minimum(least, (r[lo:lo + 2048].astype(np.uint64)[:, None] * seeds[None, :]).min(axis=0), out=least)
            bands = set(enumerate(x.tobytes() for x in least.reshape(6, 6)))
            out[i] = not bands & before
            before |= bands
    return out


def fit(rows: list[np.ndarray], toxic: np.ndarray, prior: float, steps: int = 250, rate: float = 0.1, l1: float = 1e-4) -> Model:
    """``rows``: distinct features of each text in ascending order; ``toxic``: whether it is a toxic example."""
    none = np.zeros(0, np.int64)
    if not toxic.any() or toxic.all():
        return Model(none, np.zeros(0, np.float32), -30.0 if not toxic.any() else 0.0)
    keep = np.empty(len(rows), bool)
    for side in (toxic, ~toxic):
        keep[side] = originals([rows[i] for i in np.flatnonzero(side)])
    rows, toxic = [rows[i] for i in np.flatnonzero(keep)], toxic[keep]
    n_p, n_u = int(toxic.sum()), int((~toxic).sum())
    # Features of several toxic examples; of these, the ones that tell.
    seen, times = np.unique(np.concatenate([r for r, t in zip(rows, toxic) if t]), return_counts=True)
    some = seen[times >= max(MIN_TEXTS, MIN_TOXIC_SHARE * n_p)].astype(np.int64)
    row, column = [], []
    for i, r in enumerate(rows):
        at = np.searchsorted(some, r)
        at = at[(at < len(some)) & (some[np.minimum(at, len(some) - 1)] == r)] if len(some) else none
        row.append(np.full(len(at), i, np.int32))
        column.append(at)
    row, column, n = np.concatenate(row), np.concatenate(column), len(rows)
    del rows, r, seen, times
    # A feature counts if it is clearly more frequent in toxic examples, and if by the prior
    # most unlabelled texts that have it are toxic.
    share_p = np.bincount(column[toxic[row]], minlength=len(some)) / n_p
    share_u = np.bincount(column[~toxic[row]], minlength=len(some)) / n_u
    both = (share_p * n_p + share_u * n_u) / (n_p + n_u)
    z = (share_p - share_u) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n_p + 1 / n_u))
    telling = (z >= MIN_Z) & (prior * share_p >= MIN_SHARE * share_u)
    used = telling[column]
    known = some[telling]
    row, column = row[used], (np.cumsum(telling) - 1)[column[used]]
    p, u = toxic, ~toxic
    w, bias = np.zeros(len(known)), np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    m = v = np.zeros(len(known) + 1)
    for step in range(1, steps + 1):
        g = bias + np.bincount(row, w[column], minlength=n)
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        loss = np.logaddexp(0, g)  # of calling a text clean
        negative = loss[u].mean() - prior * loss[p].mean()
        slope = np.zeros(n)
        if negative >= 0:
            slope[p] = prior * (s[p] - 1 - s[p]) / p.sum()
            slope[u] = s[u] / u.sum()
        else:
            slope[p] = prior * s[p] / p.sum()
            slope[u] = -s[u] / u.sum()
        grad = np.append(np.bincount(column, slope[row], minlength=len(known)), slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-4)
        w, bias = w - move[:-1], bias - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - l1, 0)
    strong = np.abs(w) > 0.05
    return Model(known[strong], w[strong].astype(np.float32), float(bias))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_toxic: int = MAX_TOXIC, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on the given rows: documents and the labels to learn from."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0)).alias("toxic")).first()
    total = docs.count()
    if not counts.toxic or not total:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -30.0)
    prior = counts.toxic / counts.n

    def some(ids: DataFrame, size: int, bound: int, seed: int) -> DataFrame:
        share = min(1.0, bound / max(size, 1))
        return ids.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000) + (share == 1.0)).limit(bound)

    positive = some(known.where("y = 1").select("id"), counts.toxic, max_toxic, 1).withColumn("toxic", F.lit(True))
    other = some(docs.select(F.col(id_col).alias("id")), total, max_unlabelled, 2).withColumn("toxic", F.lit(False))
    # At most MAX_TOXIC + MAX_UNLABELLED ids, so this side may be broadcast.
    chosen = F.broadcast(positive.unionByName(other))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")

    def extract(batches):
        for batch in batches:
            sets = []
            for lo, hi, block in blocks([(t or "").lower() for t in batch.column(1).to_pylist()], False, _BETWEEN):
                doc, feature = features(block)
                once = np.unique((doc << 32) | feature)
                cuts = np.searchsorted(once >> 32, np.arange(1, hi - lo))
                sets += [x.astype("<u4").tobytes() for x in np.split(once & 0xFFFF_FFFF, cuts)]
            yield {"toxic": batch.column(0), "features": sets}

    schema = T.StructType([T.StructField("toxic", T.BooleanType()), T.StructField("features", T.BinaryType())])
    found = tabulate(texts.select("toxic", "text"), schema, extract).toArrow()
    flags = np.array(found.column("toxic").to_pylist(), bool)
    # Views of the table: the features are held once, and let go of before the driver goes on.
    model = fit([np.frombuffer(b.as_buffer(), "<u4") for b in found.column("features")], flags, prior)
    del found
    hand_back()
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add ``score`` (0 to 1, higher: more likely toxic) and ``predicted`` (1 from the threshold on)."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def run(values: list) -> list[list]:
        found = model.scores(values)
        return [found.tolist(), (found >= threshold).astype(int).tolist()]

    return annotate(docs, text_col, fields, run)
