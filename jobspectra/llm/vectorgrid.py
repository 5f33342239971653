"""A stated set of query vectors against all vectors, in blocks of bounded size.

Both sides are packed into arrays in their own tasks. Every query block meets every row
block once: rows are dealt to ``slots``, queries to ``chunks``, and the pair of both is the
key that a co-group works on. A group holds about ``ROWS_EACH`` rows and at most
``QUERIES_EACH`` queries whatever ids, labels or copies the table has, because places
depend on the order of reading only. A vector is shuffled once per block of the other
side, so bytes moved stay under a hundredth of a byte per pair of vectors compared. Small
tables are cut finer so that all cores have work.

Components become ``floor(256 * x)``. Vectors that are null, hold null or non-finite
components (also those that overflow when multiplied) and rows without an id take no
part. Vectors of different lengths are not compared with one another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobspectra.llm.words import tabulate

ROWS_EACH, QUERIES_EACH, PIECE = 32_768, 8_192, 2_048
SAFE = 1 << 61
_PACKED = T.StructType([T.StructField("part", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("n", T.IntegerType()),
                        *[T.StructField(n, T.BinaryType()) for n in ("ids", "labels", "keys", "data")],
                        T.StructField("notes", T.ArrayType(T.ArrayType(T.LongType())))])


@dataclass
class Vectors:
    """Some vectors of one length as exact integers: int64, or Python integers where those could overflow."""

    ids: np.ndarray
    labels: np.ndarray
    keys: np.ndarray
    matrix: np.ndarray
    notes: list

    @property
    def largest(self) -> int:
        return int(np.abs(self.matrix).max()) if self.matrix.size else 0

    def exact_with(self, other: Vectors) -> tuple[np.ndarray, np.ndarray]:
        """Both matrices in a type in which no inner product overflows."""
        if self.matrix.shape[1] * max(self.largest, 1) * max(other.largest, 1) < SAFE:
            return self.matrix, other.matrix
        return self.matrix.astype(object), other.matrix.astype(object)


def quantised(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of floored components, as doubles) of the usable vectors, by length."""
    lists = column.cast(pa.list_(pa.float64()))
    sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes >= 0]).tolist():
        places = np.flatnonzero(sizes == size)
        flat = lists.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore", invalid="ignore"):
            matrix = np.floor(256.0 * np.asarray(flat, np.float64)).reshape(len(places), size)
        good = np.isfinite(matrix).all(axis=1)
        yield places[good], matrix[good]


def _small(matrix: np.ndarray) -> bytes:
    """Floored components are whole doubles; most fit two or four bytes."""
    for kind in (np.int16, np.int32):
        if not matrix.size or (matrix.min() >= np.iinfo(kind).min and matrix.max() <= np.iinfo(kind).max):
            return matrix.astype(kind).tobytes()
    return matrix.tobytes()


def _whole(data: bytes, n: int, dim: int) -> np.ndarray:
    if not n * dim:
        return np.zeros((n, dim), np.int64)
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[len(data) // (n * dim)]
    matrix = np.frombuffer(data, kind).reshape(n, dim)
    if kind is np.float64 and np.abs(matrix).max() >= SAFE:
        return np.array([[int(x) for x in row] for row in matrix], object).reshape(n, dim)
    return matrix.astype(np.int64)


def _pack(df: DataFrame, size: int) -> DataFrame:
    """Rows (id, label, key, vector, notes) as arrays of at most ``size``; ``part`` counts them up from the number of the task."""

    def run(batches):
        part = TaskContext.get().partitionId()
        for batch in batches:
            ids, labels, keys = (batch.column(n).fill_null(0).to_numpy(zero_copy_only=False) for n in ("id", "label", "key"))
            notes = batch.column("notes").to_pylist()
            for places, matrix in quantised(batch.column("vector")):
                for lo in range(0, len(places), size):
                    at, part = places[lo:lo + size], part + 1
                    yield {"part": [part], "dim": [matrix.shape[1]], "n": [len(at)], "ids": [ids[at].tobytes()], "labels": [labels[at].tobytes()],
                           "keys": [keys[at].tobytes()], "data": [_small(matrix[lo:lo + size])], "notes": [[notes[i] for i in at]]}

    return tabulate(df, _PACKED, run)


def _unpack(table: pa.Table) -> dict[int, Vectors]:
    """The vectors of a group by length."""
    found: dict[int, list] = {}
    for row in table.to_pylist():
        ids, labels, keys = (np.frombuffer(row[k], np.int64) for k in ("ids", "labels", "keys"))
        found.setdefault(row["dim"], []).append((ids, labels, keys, _whole(row["data"], row["n"], row["dim"]), row["notes"] or []))
    return {dim: Vectors(*(np.concatenate(c) for c in list(zip(*some))[:4]), [x for s in some for x in s[4]]) for dim, some in found.items()}


def meet(rows: DataFrame, queries: DataFrame, schema: T.StructType, work: Callable[[Vectors, Vectors], pa.Table], rows_each: int = ROWS_EACH,
         queries_each: int = QUERIES_EACH) -> DataFrame:
    """``work(rows, queries)`` for every pair of a row block and a query block of one vector length.

    ``rows`` and ``queries`` have the columns id, label, key (long), vector and notes (array<long> or null).
    """
    spark = rows.sparkSession
    n_rows, n_queries = rows.count(), queries.count()
    slots = max(1, -(-n_rows // rows_each))
    wanted = -(-3 * spark.sparkContext.defaultParallelism // slots)
    chunks = max(1, -(-n_queries // queries_each), min(wanted, -(-n_queries // 64)))
    left = _pack(rows, PIECE).withColumn("slot", F.pmod("part", F.lit(slots)).cast("int")) \
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = _pack(queries.repartition(chunks), queries_each).withColumn("chunk", F.pmod("part", F.lit(chunks)).cast("int")) \
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    keys, tasks = ["slot", "chunk"], min(2 * slots * chunks, 20_000)

    def run(some: pa.Table, asked: pa.Table) -> pa.Table:
        a, b = _unpack(some), _unpack(asked)
        found = [work(a[dim], b[dim]) for dim in sorted(set(a) & set(b))]
        return pa.concat_tables(found) if found else empty(schema)

    return left.repartition(tasks, *keys).groupBy(keys).cogroup(right.repartition(tasks, *keys).groupBy(keys)).applyInArrow(run, schema)


def empty(schema: T.StructType) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema).empty_table()


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(at) > k:
        at = np.flatnonzero(scores >= (np.partition(scores, len(scores) - k)[len(scores) - k] if scores.dtype != object else sorted(scores)[-k]))
    return at[np.lexsort((ids[at], -scores[at]))][:k]
