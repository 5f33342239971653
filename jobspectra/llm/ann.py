"""Approximate nearest neighbours over learned partitions.

A bounded sample (``SAMPLE`` vectors) gives a neighbour graph, which is cut into balanced
partitions by repeated bisection: the halves are the lower and upper half of a smooth
vector on the graph (power iteration). A small network learns to tell a vector's
partition. Every row is indexed under its most probable partition; a query visits its
``probes`` most probable ones, and everything found there is ranked by exact Euclidean
distance in double precision, ties to the smaller id. ``probes`` is the least number that
finds ``TARGET`` of the true neighbours within the sample.

Partitions are dealt out in chunks of rows and of queries, by counts per partition, so a
crowded partition (copies of one vector, say) spreads over tasks and memory is bounded.

Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part. Fewer candidates than wanted give fewer results. Equal query rows
are one query; different vectors under one query id are queries of their own. Every row
counts as a candidate, repeated ones too, but for those with the query's id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobspectra.llm.words import tabulate

SAMPLE = 8_192
MAX_PARTITIONS = 64
ROWS_EACH = 1_000
NEIGHBOURS = 12
TARGET = 0.94
ROW_CHUNK, QUERY_CHUNK = 8_192, 4_096


def vectors(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix) of the usable vectors of a list column."""
    lists = column.cast(pa.list_(pa.float64()))
    if dim is None:
        lens = [v for v in lists.value_lengths().to_pylist() if v]
        dim = max(set(lens), key=lens.count) if lens else 0
    sizes = np.array([-1 if v is None else v for v in lists.value_lengths().to_pylist()], np.int64)
    places = np.flatnonzero(sizes == dim) if dim else np.zeros(0, np.int64)
    flat = lists.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False) if len(places) else np.zeros(0)
    matrix = np.asarray(flat, np.float64).reshape(len(places), max(dim, 1))
    good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
    return places[good], matrix[good]


@dataclass
class Index:
    """Partition classifier: one hidden layer; ``weights`` is empty for a single partition."""

    dim: int
    partitions: int
    probes: int
    centre: np.ndarray
    scale: float
    weights: tuple[np.ndarray, ...]

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Partitions of each vector, most probable first."""
        if not self.weights:
            return np.zeros((len(x), 1), np.int64)
        w1, b1, w2, b2 = self.weights
        logits = np.maximum((x - self.centre) / self.scale @ w1 + b1, 0) @ w2 + b2
        return np.argsort(-logits, axis=1, kind="stable")


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest other rows of each row."""
    out = np.empty((len(x), k), np.int64)
    norms = (x * x).sum(axis=1)
    for lo in range(0, len(x), 512):
        d = norms[None, :] - 2 * x[lo:lo + 512] @ x.T
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        out[lo:lo + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def partition(near: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Balanced partition of a neighbour graph: at each cut every half gets half of the rows."""
    label = np.zeros(len(near), np.int64)
    rng = np.random.default_rng(seed)
    count = 1
    while count < parts:
        new = label.copy()
        for p in range(count):
            rows = np.flatnonzero(label == p)
            if len(rows) < 4:
                continue
            at = np.full(len(near), -1)
            at[rows] = np.arange(len(rows))
            a = np.repeat(np.arange(len(rows)), near.shape[1])
            b = at[near[rows].ravel()]
            a, b = a[b >= 0], b[b >= 0]
            a, b = np.concatenate((a, b)), np.concatenate((b, a))
            degree = np.bincount(a, minlength=len(rows)) + 1.0
            v = rng.standard_normal(len(rows))
            for _ in range(60):
                v = v - (v * degree).sum() / degree.sum()
                v = (v + np.bincount(a, v[b], len(rows))) / degree
                v /= np.abs(v).max() + 1e-30
            upper = np.argsort(v, kind="stable")[len(rows) // 2:]
            new[rows[upper]] = p + count
        label, count = new, 2 * count
    return label


def learn(x: np.ndarray, y: np.ndarray, parts: int, hidden: int = 128, epochs: int = 40, seed: int = 3) -> tuple[np.ndarray, ...]:
    """Weights of the classifier (minibatch Adam on the cross-entropy)."""
    rng = np.random.default_rng(seed)
    w = [rng.standard_normal((x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(hidden),
         rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(epochs):
        rate = 0.004 * 0.93 ** epoch
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.maximum(x[rows] @ w[0] + w[1], 0)
            logits = h @ w[2] + w[3]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = (p @ w[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((x[rows].T @ back, back.sum(axis=0), h.T @ p, p.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    return tuple(w)


def fit(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, target: float = TARGET) -> Index:
    """Learn partitions from a sample of the usable rows, chosen by a hash of the id."""
    x, none = F.col(vector_col), F.lit(False)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    table = table.where(~F.coalesce(odd, ~none) & F.coalesce(F.exists(x, lambda v: v != 0), none))
    total = table.count()
    share = min(1.0, SAMPLE / max(total, 1))
    chosen = table.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1_000_000)) <= int(share * 1_000_000)).limit(SAMPLE)
    _, x = vectors(chosen.select(vector_col).toArrow().column(0).combine_chunks())
    parts = 1
    while parts * 2 <= min(MAX_PARTITIONS, total / ROWS_EACH, len(x) / 32):
        parts *= 2
    dim = x.shape[1]
    centre = x.mean(axis=0) if len(x) else np.zeros(dim)
    scale = float(x.std()) if len(x) and x.std() > 0 else 1.0
    if parts == 1:
        return Index(dim, 1, 1, centre, scale, ())
    k = min(k, len(x) - 1)
    near = neighbours(x, max(k, min(NEIGHBOURS, len(x) - 1)))
    labels = partition(near, parts)
    index = Index(dim, parts, parts, centre, scale, learn((x - centre) / scale, labels, parts))
    # Least number of probes that finds the wanted share of neighbours in the sample.
    ranked = index.ranked(x)
    place = np.empty_like(ranked)
    np.put_along_axis(place, ranked, np.arange(parts)[None, :].repeat(len(x), 0), 1)
    some = np.arange(0, len(x), max(1, len(x) // 1024))
    d = neighbours_of(x, some, k)
    needed = place[some[:, None], ranked[d, 0]]
    found = np.cumsum(np.bincount(needed.ravel(), minlength=parts)) / needed.size
    index.probes = int(np.searchsorted(found, target) + 1)
    return index


def neighbours_of(x: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    norms = (x * x).sum(axis=1)
    d = norms[None, :] - 2 * x[rows] @ x.T
    d[np.arange(len(rows)), rows] = np.inf
    return np.argpartition(d, k - 1, axis=1)[:, :k]


def _nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int):
    """(query's place, row id, distance) of the k nearest rows of each query."""
    norms = (rows * rows).sum(axis=1)
    for lo in range(0, len(queries), 256):
        block = queries[lo:lo + 256]
        rough = norms[None, :] - 2 * block @ rows.T + (block * block).sum(axis=1)[:, None]
        rough[query_ids[lo:lo + 256, None] == row_ids[None, :]] = np.inf
        kth = np.partition(rough, min(k, rough.shape[1]) - 1, axis=1)[:, min(k, rough.shape[1]) - 1]
        for q, limit in enumerate(kth):
            # Rounding may swap near-equal rows: rank all that come near the limit exactly.
            limit = limit if np.isfinite(limit) else np.finfo(float).max
            near = np.flatnonzero(rough[q] <= limit + 1e-9 * max(1.0, abs(limit)) if limit < 1e300 else np.isfinite(rough[q]))
            if len(near):
                exact = np.sqrt(((rows[near] - block[q]) ** 2).sum(axis=1))
                best = np.lexsort((row_ids[near], exact))[:k]
                yield np.full(len(best), lo + q), row_ids[near][best], exact[best]


def search(table: DataFrame, queries: Column, index: Index, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row that satisfies ``queries``: query_id, rank, the neighbour's id and distance."""
    placed_schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", T.BinaryType()), T.StructField("is_query", T.BooleanType()),
                                  T.StructField("parts", T.ArrayType(T.IntegerType()))])

    def place(batches):
        for batch in batches:
            at, x = vectors(batch.column(1), index.dim)
            ids, asked = batch.column(0).take(pa.array(at)), batch.column(2).take(pa.array(at)).to_pylist()
            ranked = index.ranked(x)[:, :index.probes] if len(x) else np.zeros((0, 1), np.int64)
            yield {"id": ids, "vector": [v.tobytes() for v in x], "is_query": asked,
                   "parts": [r.tolist() if q else [int(r[0])] for r, q in zip(ranked, asked)]}

    source = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    placed = tabulate(source.where("id IS NOT NULL"), placed_schema, place)

    # At most one row per partition, so these tables are small whatever the input is.
    home = F.col("parts")[0]
    sizes = {r.part: (r.rows, r.queries) for r in placed.select(F.explode(F.when(F.col("is_query"), F.col("parts")).otherwise(F.array(home))).alias("part"), "is_query", home.alias("home"))
             .groupBy("part").agg(F.sum((F.col("part") == F.col("home")).cast("long")).alias("rows"), F.sum(F.col("is_query").cast("long")).alias("queries")).collect()}
    chunks = F.create_map(*[F.lit(v) for p, (r, _) in sizes.items() for v in (p, max(1, -(-r // ROW_CHUNK)))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    asked = F.create_map(*[F.lit(v) for p, (_, q) in sizes.items() for v in (p, max(1, -(-q // QUERY_CHUNK)))]) if sizes else F.create_map(F.lit(0), F.lit(1))

    own = lambda column, salt: F.pmod(F.xxhash64("id", F.lit(salt)), column).cast("int")
    rows = placed.select("id", "vector", home.alias("part")).withColumn("row_chunk", own(chunks[F.col("part")], 1)) \
        .withColumn("query_chunk", F.explode(F.sequence(F.lit(0), asked[F.col("part")] - 1)))
    # Equal query rows are one query; different vectors under one id are told apart by their hash.
    asked_once = placed.where("is_query").dropDuplicates(["id", "vector"]).withColumn("key", F.xxhash64("id", "vector"))
    wanted = asked_once.select("id", "vector", "key", F.explode("parts").alias("part")).withColumn("query_chunk", own(asked[F.col("part")], 2)) \
        .withColumn("row_chunk", F.explode(F.sequence(F.lit(0), F.coalesce(chunks[F.col("part")], F.lit(1)) - 1)))
    key = ["part", "row_chunk", "query_chunk"]
    found_schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    dim = index.dim

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            matrix = lambda t: np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64).reshape(-1, dim)
            ids = lambda t: t.column("id").to_numpy()
            out = list(_nearest(matrix(right), ids(right), matrix(left), ids(left), k))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        asked_by = right.select(["id", "key"]).take(pa.array(columns[0]))
        return pa.table({"query_id": asked_by.column("id"), "key": asked_by.column("key"), "vec_id": columns[1], "score": columns[2]})

    found = rows.groupBy(key).cogroup(wanted.groupBy(key)).applyInArrow(rank, found_schema)
    order = Window.partitionBy("query_id", "key").orderBy("score", "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
