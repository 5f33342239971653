"""Exact top-k search by inner product over a bit-sliced index.

A block of vectors is indexed attribute by attribute: bitmap j of an attribute holds bit j
of its (shifted) value in every row. Only the ``slices`` most significant bits are kept,
so the attributes are quantised. A query adds shifted slices with bitmap arithmetic: its
components are written in signed binary digits, a negative digit takes the complement,
and carry-save adders (xor, and, or) sum all slices of one weight, which gives the slices
of the score. The k-th highest score is read off from the most significant slice
downward. What the dropped bits could add is bounded, so all rows within that bound of
the k-th are the boundary rows; their scores are computed exactly from the whole vectors.
The result is exact.

Repeated rows: a row with the query's id is the query's own; other rows all count. Equal
query rows are one query; different vectors under one query id are queries of their own,
whose ranks each start at 1. Blocks, nulls and odd vectors: see ``vectorgrid``. Scores
must fit a long, as their column does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobspectra.llm.vectorgrid import Vectors, best, empty, meet

SLICES = 6


class SlicedBlock:
    """Bitmaps of a block: ``maps[d * bits + j]`` is bit j of attribute d; the complements follow."""

    def __init__(self, matrix: np.ndarray, slices: int = SLICES):
        self.rows, dim = matrix.shape
        above = matrix - matrix.min(axis=0) if matrix.size else matrix
        whole = int(above.max()).bit_length() if above.size else 0
        self.drop = max(0, whole - slices)
        self.bits = max(1, whole - self.drop)
        kept = (above >> self.drop).astype(np.int64)
        flags = np.empty((dim, self.bits, -(-self.rows // 64) * 8), np.uint8)
        for j in range(self.bits):
            packed = np.packbits(((kept >> j) & 1).astype(np.uint8), axis=0, bitorder="little")
            flags[:, j, :packed.shape[0]] = packed.T
            flags[:, j, packed.shape[0]:] = 0
        maps = flags.reshape(dim * self.bits, flags.shape[2]).view(np.uint64)
        self.maps, self.complement = np.concatenate((maps, ~maps)), dim * self.bits

    def bitmap(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.maps.shape[1] * 8, np.uint8)
        packed = np.packbits(flags, bitorder="little")
        out[:len(packed)] = packed
        return out.view(np.uint64)

    def places(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of the weighted sum of all attributes, least significant first; each row's sum is off by the same constant."""
        # Signed digits: query = sum of 2^i * (plus_i - minus_i), few of them non-zero.
        plus, minus = ((3 * query) & ~query) >> 1, (query & ~(3 * query)) >> 1
        length = max([int(x).bit_length() for x in (*plus, *minus)], default=0)
        starts = [np.concatenate((np.flatnonzero((plus >> i) & 1) * self.bits, np.flatnonzero((minus >> i) & 1) * self.bits + self.complement))
                  for i in range(length)]
        out, carried, weight = [], [], 0
        while weight < length + self.bits - 1 or carried:
            own = [starts[weight - j] + j for j in range(self.bits) if 0 <= weight - j < length]
            held = [self.maps[np.concatenate(own)]] if own else []
            held = np.concatenate([*held, *carried]) if held or carried else np.zeros((0, self.maps.shape[1]), np.uint64)
            carried = []
            while len(held) > 1:
                third = max(len(held) // 3, 1)
                a, b = held[:third], held[third:2 * third]
                odd = a ^ b
                if len(held) == 2:
                    carried.append(a & b)
                    held = odd
                else:
                    c = held[2 * third:3 * third]
                    carried.append((a & b) | (odd & c))
                    held = np.concatenate((odd ^ c, held[3 * third:]))
            out.append(held[0] if len(held) else np.zeros(self.maps.shape[1], np.uint64))
            weight += 1
        return out

    def boundary(self, query: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
        """Places of all rows that may be among the k highest of the allowed ones."""
        if int(np.bitwise_count(allowed).sum()) <= k:
            return self.places(allowed)
        sums = self.sums(query)
        sure, open_, kth = np.zeros_like(allowed), allowed, 0
        for one in reversed(sums):
            high = open_ & one
            enough = int(np.bitwise_count(sure | high).sum()) >= k
            kth = 2 * kth + enough
            sure, open_ = (sure, high) if enough else (sure | high, open_ & ~one)
        # Dropped bits move a score by what lies between their least and their largest sum.
        least = kth - ((1 << self.drop) - 1) * sum(abs(int(x)) for x in query) // (1 << self.drop)
        above, equal = np.zeros_like(allowed), allowed
        for at in reversed(range(len(sums))):
            if least <= 0:
                break
            if least >> at & 1:
                equal = equal & sums[at]
            else:
                above, equal = above | (equal & sums[at]), equal & ~sums[at]
        return self.places(above | equal)


_FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("query_id", "key", "vec_id", "score")])


def _work(k: int, slices: int):
    def run(rows: Vectors, queries: Vectors) -> pa.Table:
        matrix, asked = rows.exact_with(queries)
        block, out = SlicedBlock(rows.matrix, slices), []
        for own, key, query in zip(queries.ids, queries.keys, asked):
            at = block.boundary(query, block.bitmap(rows.ids != own), k)
            scores = matrix[at] @ query if matrix.shape[1] else np.zeros(len(at), np.int64)
            top = best(scores, rows.ids[at], k)
            out.append((np.full(len(top), own), np.full(len(top), key), rows.ids[at][top], scores[top].astype(np.int64)))
        return pa.table(dict(zip(_FOUND.names, map(np.concatenate, zip(*out))))) if out else empty(_FOUND)
    return run


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """The columns that ``vectorgrid.meet`` takes, of rows with an id and a vector."""
    return table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL") \
        .select("id", F.lit(0).cast("long").alias("label"), F.lit(0).cast("long").alias("key"), "vector", F.lit(None).cast("array<bigint>").alias("notes"))


def search(table: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", slices: int = SLICES) -> DataFrame:
    """For each row that satisfies ``queries`` its k rows of highest inner product: query_id, rank, vec_id, score."""
    asked = vectors(table.where(queries), id_col, vector_col).dropDuplicates(["id", "vector"]).withColumn("key", F.xxhash64("id", "vector"))
    found = meet(vectors(table, id_col, vector_col), asked, _FOUND, _work(k, slices))
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
