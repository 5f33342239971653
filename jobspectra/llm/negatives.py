"""Hard negatives by exact inner products, many candidates to a multiplication.

Kronecker-packed products: the candidates' components of one dimension, biased so that
none is negative, lie side by side in fields of one wide integer. An anchor multiplies
each of these integers once with its own component and adds the products up; every field
then holds one candidate's score, which is read off exactly. Fields are as wide as the
largest possible sum of the block asks for, so no sum runs over into the next field.

Two passes over all rows, in blocks (see ``vectorgrid``, also for nulls and odd vectors):
the best other rows of an anchor's label are its positives; then, for each positive, the
best rows of other labels whose score lies between two shares of the positive's score.
Each block gives its best few of each list, and the best of those are the result, so no
list of candidates is gathered anywhere.

Rows with a null label take no part. A row with the anchor's id is not another row. Equal
anchor rows are one anchor; different rows under one anchor id are anchors of their own.
Equal positives are listed one by one. Scores must fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobspectra.llm.shared import stored
from jobspectra.llm.vectorgrid import Vectors, best, empty, meet

ROWS_EACH = 16_384
FIELDS = 2_048


class Packed:
    """Wide integers of some candidates: one per dimension and ``FIELDS`` candidates."""

    def __init__(self, matrix: np.ndarray, largest_anchor: int):
        self.rows, self.dim = matrix.shape
        self.bias = -int(matrix.min()) if matrix.size else 0
        biased = matrix + self.bias
        self.top = int(biased.max()) if matrix.size else 0
        # A field holds the sum of all products and the offset that keeps it from falling below zero.
        self.width = max(1, -(-(2 * self.dim * self.top * largest_anchor).bit_length() // 8))
        self.wide = []
        for lo in range(0, self.rows, FIELDS):
            some = biased[lo:lo + FIELDS]
            ones = int.from_bytes((b"\1" + bytes(self.width - 1)) * len(some), "little")
            self.wide.append((len(some), ones, [int.from_bytes(self._fields(some[:, d]), "little") for d in range(self.dim)]))

    def _fields(self, values: np.ndarray) -> bytes:
        if values.dtype == object or self.width > 8:
            return b"".join(int(v).to_bytes(self.width, "little") for v in values)
        return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :self.width]).tobytes()

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """The exact inner product of every candidate with the anchor."""
        parts = [int(x) for x in anchor]
        offset = -self.top * sum(x for x in parts if x < 0)
        off_by = offset + self.bias * sum(parts)
        out = []
        for n, ones, wide in self.wide:
            total = ones * offset
            for x, candidates in zip(parts, wide):
                total += x * candidates
            out.append(self._read(total.to_bytes(n * self.width, "little"), n))
        return (np.concatenate(out) if out else np.zeros(0, np.int64)) - off_by

    def _read(self, data: bytes, n: int) -> np.ndarray:
        if self.width > 7:
            return np.array([int.from_bytes(data[i:i + self.width], "little") for i in range(0, n * self.width, self.width)], object)
        field = np.zeros((n, 8), np.uint8)
        field[:, :self.width] = np.frombuffer(data, np.uint8).reshape(n, self.width)
        return field.view("<i8")[:, 0].astype(np.int64)


_POSITIVES = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor_id", "key", "positive_id", "positive_score")])
_NEGATIVES = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor_id", "key", "nth", "positive_id", "negative_id", "positive_score", "negative_score")])


def _table(schema: T.StructType, out: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate(c).astype(np.int64)) for n, c in zip(schema.names, zip(*out))}) if out else empty(schema)


def _positives(k: int):
    def run(rows: Vectors, anchors: Vectors) -> pa.Table:
        packed, out = Packed(rows.matrix, anchors.largest), []
        for own, label, key, anchor in zip(anchors.ids, anchors.labels, anchors.keys, anchors.matrix):
            at = np.flatnonzero((rows.labels == label) & (rows.ids != own))
            if len(at):
                scores = packed.scores(anchor)[at]
                top = best(scores, rows.ids[at], k)
                out.append((np.full(len(top), own), np.full(len(top), key), rows.ids[at][top], scores[top]))
        return _table(_POSITIVES, out)
    return run


def _negatives(k: int, low: int, high: int):
    def run(rows: Vectors, anchors: Vectors) -> pa.Table:
        packed, out = Packed(rows.matrix, anchors.largest), []
        for own, label, key, anchor, notes in zip(anchors.ids, anchors.labels, anchors.keys, anchors.matrix, anchors.notes):
            other = (rows.labels != label) & (rows.ids != own)
            scores = packed.scores(anchor)
            for nth, positive, score in zip(*[iter(notes)] * 3):
                # low * score <= 100 * x <= high * score, in whole numbers of x
                at = np.flatnonzero(other & (scores >= -(-low * score // 100)) & (scores <= high * score // 100))
                if len(at):
                    top = best(scores[at], rows.ids[at], k)
                    same = [np.full(len(top), v) for v in (own, key, nth, positive, score)]
                    out.append((*same[:4], rows.ids[at][top], same[4], scores[at][top]))
        return _table(_NEGATIVES, out)
    return run


def mine(table: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id",
         label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """For every anchor and positive, the first rows of other labels between ``low`` and ``high`` percent of the positive's score:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    none = F.lit(None).cast("array<bigint>").alias("notes")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.lit(0).cast("long").alias("key"),
                        F.col(vector_col).alias("vector"), none, F.coalesce(anchors, F.lit(False)).alias("asked")) \
        .where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    asked = rows.where("asked").drop("asked").dropDuplicates(["id", "label", "vector"]).withColumn("key", F.xxhash64("id", "label", "vector"))
    rows = rows.drop("asked")
    found = meet(rows, asked, _POSITIVES, _positives(positives), ROWS_EACH)
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("positive_score"), "positive_id")
    first = found.withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= positives)
    # At most a few positives to an anchor, in one flat list: place, id, score, place, ...
    lists = first.groupBy("anchor_id", "key").agg(F.flatten(F.sort_array(F.collect_list(F.array("nth", "positive_id", "positive_score")))).alias("notes"))
    ready = asked.drop("notes").join(lists.withColumnRenamed("anchor_id", "id"), ["id", "key"]).select("id", "label", "key", "vector", "notes")
    ready = stored(ready, "anchors")  # the grid counts them first: the first pass runs once
    found = meet(rows, ready, _NEGATIVES, _negatives(negatives, low, high), ROWS_EACH)
    order = Window.partitionBy("anchor_id", "key", "nth").orderBy(F.desc("negative_score"), "negative_id")
    best_of = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return best_of.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
