"""Near-duplicate documents by HyperMinHash sketches.

A document is the set of its distinct word shingles. Its sketch has ``REGISTERS``
registers; each keeps, for its own hash function, the leading-zero count of the smallest
shingle hash and the ``MANTISSA`` bits after the leading one (16 bits instead of 64).
Bands of registers propose candidates; they are as wide as a pair right at the similarity
limit allows that is to miss all of them with a probability under ``MISSED`` (36 bands of 5
and 6e-7 at the limit of 0.8). The share of equal registers, corrected for
registers that agree by chance, estimates the similarity of a candidate; one within five
standard errors of the limit is confirmed on the full shingle sets.

Groups of any size stay cheap and are never expanded into all pairs:

* documents with equal sets are one node from the start;
* first each node is compared only with the smallest node of each of its buckets, and
  joined to the one that looks most similar;
* after that only nodes that still share a bucket with another component are looked at,
  and of those only pairs that share a shingle early in a common order, rare ones first.

Components come from pointer jumping on tables; links and labels never leave the
executors. Null texts and texts without words have an empty set and link with nothing.

Repeated rows give repeated result rows. An id with several different texts is linked
through each of them, and its rows share one component: all its sets take part, and the
nodes that stand for them are linked with one another. Other columns are not read, so
clashing names do no harm. Equal sizes, counts and hashes are ordered by id.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobspectra.llm.shared import stored
from jobspectra.llm.words import blocks, mix, tabulate

REGISTERS = 180
MISSED = 1e-6
MANTISSA = 10
COUNTERS = 1 << 18
_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

SKETCH = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
    T.StructField("registers", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())),
])


def shingle_sets(texts: list[str | None], k: int):
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    for lo, hi, block in blocks(texts, True):
        words = block.hashes()
        grams, at = block.ngrams(words, k)
        first = np.searchsorted(at, block.first_word)
        for d in range(hi - lo):
            n = int(block.n_words[d])
            if n >= k:
                yield np.unique(grams[first[d]:first[d + 1]])
            elif n:
                total = np.full(1, n, np.uint64)
                for w in words[block.first_word[d]:block.first_word[d + 1]]:
                    total = mix(total * np.uint64(31) + w)
                yield total
            else:
                yield np.zeros(0, np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """Compressed minima: leading zeros in the high bits, mantissa in the low ones."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[lo:lo + 1024, None] * _SEEDS[None, :]).min(axis=0), out=least)
    zeros = np.uint64(64) - np.frexp(least.astype(np.float64))[1].astype(np.uint64)
    zeros = np.minimum(zeros, np.uint64(63))
    rest = (least << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | rest).astype(np.uint16)


def band_rows(percent: int) -> int:
    """Registers to a band: the most with which a pair at the limit is not missed."""
    rows = 1
    while (1 - (percent / 100) ** (rows + 1)) ** (REGISTERS // (rows + 1)) <= MISSED:
        rows += 1
    return rows


def band_keys(regs: np.ndarray, rows: int = band_rows(80)) -> np.ndarray:
    bands = REGISTERS // rows
    parts = regs[:bands * rows].reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, r])
    return key


def chance(ratio: float, n: int = 1000) -> float:
    """Probability that the registers of two disjoint sets of n and ratio * n shingles agree."""
    high = 2.0 ** -np.arange(0, 40)[:, None] * (1 - np.arange(2 ** MANTISSA)[None, :] / 2 ** (MANTISSA + 1))
    low = high - 2.0 ** -np.arange(0, 40)[:, None] / 2 ** (MANTISSA + 1)
    share = lambda m: np.exp(m * np.log1p(-np.minimum(low, 1 - 1e-12))) - np.exp(m * np.log1p(-np.minimum(high, 1 - 1e-12)))
    return float((share(n) * share(n * ratio)).sum())


_CHANCE = chance(1.0)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from registers (one pair per row), corrected for accidental agreement.

    Pairs near the limit have nearly equal sizes, so the probability for equal sizes serves all.
    """
    equal = (a == b).mean(axis=1)
    return (equal - _CHANCE) / (1 - _CHANCE)


def sketch(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Per row: set size, digest of the set, registers and band keys."""
    band = band_rows(percent)

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in SKETCH.fields}
            for doc_id, shingles in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), k)):
                mixed = mix(shingles + np.uint64(0x632BE59BD9B4E019))
                out["id"].append(doc_id)
                out["n"].append(len(shingles))
                out["d1"].append(int(shingles.sum().astype(np.int64)))
                out["d2"].append(int(mixed.sum().astype(np.int64)))
                regs = registers(shingles) if len(shingles) else None
                out["registers"].append(None if regs is None else regs.tobytes())
                out["keys"].append(None if regs is None else band_keys(regs, band).astype(np.int64))
            yield out

    return tabulate(docs.select(F.col(id_col).cast("long"), text_col), SKETCH, run)


def _estimated(pairs: DataFrame, nodes: DataFrame, least: float, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose registers suggest it."""
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", "r_a", "r_b")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("similar", T.DoubleType())])

    def run(batches):
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
            found = estimate(left, right)
            near = np.flatnonzero(found >= least)
            yield {"a": batch.column("a").take(near), "b": batch.column("b").take(near), "similar": found[near]}

    return tabulate(both, schema, run)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    union = F.size("s_a") + F.size("s_b") - common
    return both.where(100 * common >= percent * union).select("a", "b")


def _counters(placed: DataFrame) -> np.ndarray:
    """How many sets hold shingles of each of ``COUNTERS`` hash values."""
    schema = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    width = COUNTERS // 16

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy().view(np.uint64)
            total += np.bincount((flat % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        used = [k for k in range(16) if total[k * width:(k + 1) * width].any()]
        yield {"slice": used, "counts": [zlib.compress(total[k * width:(k + 1) * width].tobytes(), 1) for k in used]}

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(b), np.int64) for b in table.column("counts").to_pylist())
        return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())}, schema=table.schema)

    out = np.zeros(COUNTERS, np.int64)
    for r in tabulate(placed.select("shingles"), schema, count).groupBy("slice").applyInArrow(add, schema).collect():
        out[r.slice * width:(r.slice + 1) * width] = np.frombuffer(bytes(r.counts), np.int64)
    return out


def _across(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components that can reach the similarity.

    Shingles are put in one order for all sets, rare ones first. If two sets are similar,
    the first shingle they share stands early in both: at most so many can stand before
    it that what is left allows the overlap. Only those positions are joined, so edited
    copies of one text, each with rare shingles of its own, do not meet at all.
    """
    held = placed.sparkSession.sparkContext.broadcast(_counters(placed))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("id", "label", "n", "shingle", "left")])

    def early(batches):
        counts = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: dict[str, list] = {f.name: [] for f in schema.fields}
                for node, label, shingles in zip(part.column("id").to_pylist(), part.column("label").to_pylist(), part.column("shingles")):
                    own = shingles.values.to_numpy().view(np.uint64)
                    n = len(own)
                    first = n - -(-percent * n // 100) + 1
                    rare = np.lexsort((own, counts[(own % np.uint64(COUNTERS)).astype(np.int64)]))[:first]
                    out["id"].append(np.full(first, node))
                    out["label"].append(np.full(first, label))
                    out["n"].append(np.full(first, n))
                    out["shingle"].append(own[rare].view(np.int64))
                    out["left"].append(n - np.arange(first))
                yield {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}

    rows = tabulate(placed.select("id", "label", "shingles"), schema, early)
    side = lambda x: rows.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "label", "n", "left")])
    possible = f"label_a < label_b AND {100 + percent} * least(left_a, left_b) >= {percent} * (n_a + n_b)"
    return side("a").join(side("b"), "shingle").where(possible).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node: (id, label).

    Each round hooks every root to the smallest root linked with its tree, then halves
    all paths by pointer jumping. Hooking to smaller roots only keeps it a forest.
    """
    labels = nodes.select("id", F.col("id").alias("label"))
    while True:
        ends = links.join(labels.select(F.col("id").alias("a"), F.col("label").alias("x")), "a") \
            .join(labels.select(F.col("id").alias("b"), F.col("label").alias("y")), "b").where("x <> y")
        hooks = stored(ends.select(F.greatest("x", "y").alias("label"), F.least("x", "y").alias("to"))
                       .groupBy("label").agg(F.min("to").alias("to")), "hooks")
        if hooks.isEmpty():
            return labels
        roots = hooks
        while True:
            further = roots.alias("r").join(roots.alias("s"), F.col("r.to") == F.col("s.label"), "left") \
                .select("r.label", F.coalesce("s.to", "r.to").alias("to"), F.col("s.to").isNotNull().alias("moved"))
            further = stored(further, "roots")
            roots = further.select("label", "to")
            if further.where("moved").isEmpty():
                break
        labels = stored(labels.join(roots, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")


def _repeated(sketches: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids that occur more than once, and links (a, b) between the nodes that one id's rows belong to."""
    once = sketches.where("n > 0").groupBy("id").agg(F.count("*").alias("rows"), *[f(c).alias(f"{k}_{c}") for c in ("d1", "d2", "n") for k, f in (("low", F.min), ("high", F.max))])
    once = stored(once.where("rows > 1"), "repeated")
    differ = once.where("low_d1 <> high_d1 OR low_d2 <> high_d2 OR low_n <> high_n").select("id")
    nodes = sketches.where("n > 0").join(differ, "id", "left_semi").select("id", "d1", "d2", "n").distinct().join(classes, ["d1", "d2", "n"])
    first = nodes.groupBy("id").agg(F.min("node").alias("b"))
    links = nodes.join(first, "id").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    return once.select("id"), stored(links, "several")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept`` (is that id)."""
    spread = 5 * float(np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS))
    least = percent / 100 - spread
    sketches = stored(sketch(docs, k, id_col, text_col, percent), "sketches")
    classes = stored(sketches.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("node")), "classes")
    # A node has the id of the smallest row of its class; an id may stand for several classes.
    nodes = sketches.where("n > 0").join(classes.select("d1", "d2", "n", F.col("node").alias("id")), ["d1", "d2", "n", "id"]) \
        .select("id", "n", "registers", "keys", "d1", "d2").dropDuplicates(["id", "d1", "d2", "n"]).drop("d1", "d2")
    nodes = stored(nodes, "nodes")
    ids = classes.select(F.col("node").alias("id")).distinct()
    repeated, several = _repeated(sketches, classes)

    rows = nodes.select("id", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("members")).where("members > 1")
    members = stored(rows.join(buckets, "key").select("key", "id", "first"), "members")
    star = members.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    star = stored(_estimated(star, nodes, least, percent), "star")

    involved = members.select("id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(involved, "id")
    again = texts.join(repeated, "id", "left_semi").dropDuplicates(["id", "text"])
    sets = stored(_sets(texts.join(repeated, "id", "left_anti").unionByName(again), k), "sets")
    best = star.groupBy("a").agg(F.max_by("b", "similar").alias("b"))
    links = stored(_confirmed(best, sets, percent).unionByName(several), "links")
    labels = components(ids, links)

    # Nodes that still share a bucket with another component: candidates among them.
    placed = members.select("key", "id").join(labels, "id")
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    placed = placed.join(mixed, "key").select("id", "label").distinct()
    cross = stored(_across(stored(placed.join(sets, "id"), "placed"), percent), "cross")
    more = stored(_confirmed(_estimated(cross, nodes, least, percent), sets, percent), "more")
    labels = components(ids, links.unionByName(more))

    placed_classes = classes.join(labels.select(F.col("id").alias("node"), "label"), "node")
    out = sketches.select("id", "n", "d1", "d2").join(placed_classes.select("d1", "d2", "label"), ["d1", "d2"], "left")
    component = F.coalesce("label", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      (component == F.col("id")).alias("kept"))


def _sets(texts: DataFrame, k: int) -> DataFrame:
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            sets = [s.astype(np.int64) for s in shingle_sets(batch.column(1).to_pylist(), k)]
            yield {"id": batch.column(0), "shingles": sets}

    return tabulate(texts.select("id", "text"), schema, run)
