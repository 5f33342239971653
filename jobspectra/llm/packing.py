"""Packing of tokenized documents into windows by multiway differencing.

A document is its ids and an end id. Full windows are cut off its front; what is left
goes to a pool. When the pool holds ``GROUP`` windows'
worth of tokens, the piece that reaches over is cut there, its last few pieces are cut
into small change, and the group is partitioned:
every piece starts as a partial partition (the piece, and otherwise empty windows), and
the two partial partitions with the largest spread are merged again and again, fullest
window of one onto emptiest of the other. If a window then exceeds the capacity, the
group is partitioned anew into one window more.

Each task packs the documents it reads, so nothing is shuffled and a task holds one
group at a time. A group fills ``FILL`` of its windows so that the sums may differ: padding
is about 1 % of all tokens (under 1.5 % in tests), spread over the windows of a group, and the last
group of a task may leave one window emptier. Ids depend on
the partition index and order within it, both fixed by the scan, so a task that runs
again gives the same rows. Nulls count as empty texts (one end id). Extra columns are
ignored; an empty table gives no rows; repeated rows are packed each on its own; rows
of equal ids stay in the order of reading.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobspectra.llm.tokens import encoder, portions
from jobspectra.llm.words import tabulate

CAPACITY = 2048
GROUP = 128
#: Pieces of ``GRAIN`` tokens cut for each window of a group, to even out its sums.
CHANGE, GRAIN = 2, 24
#: Share of a group's windows that its pieces fill; the rest lets the sums differ.
FILL = 0.994

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    T.StructField("ids", T.BinaryType()),
])


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in at most k windows of near-equal sums (largest differencing method).

    A partial partition is kept as its non-empty windows in the order of their sums,
    counted from its emptiest window: only differences matter.
    """
    tie = itertools.count()
    heap = [(-s, next(tie), [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, sums, parts = heapq.heappop(heap)
        _, _, more, others = heapq.heappop(heap)
        if len(sums) < len(more):
            sums, parts, more, others = more, others, sums, parts
        if len(more) == 1:
            # One window: onto the emptiest of the other partition.
            s, part = more[0], others[0]
            if len(sums) == k:
                s, part = s + sums.pop(0), parts.pop(0) + part
            at = bisect.bisect(sums, s)
            sums.insert(at, s)
            parts.insert(at, part)
        else:
            # Fullest onto emptiest where both together have more than k windows.
            shared = max(0, len(sums) + len(more) - k)
            joined = [(x + y, a + b) for x, y, a, b in zip(sums[:shared], reversed(more[-shared:]), parts[:shared], reversed(others[-shared:]))] if shared else []
            joined += zip(sums[shared:], parts[shared:])
            joined += zip(more[:len(more) - shared], others[:len(more) - shared])
            joined.sort(key=lambda w: w[0])
            sums, parts = [w[0] for w in joined], [w[1] for w in joined]
        if len(sums) == k and sums[0]:
            low = sums[0]
            sums = [s - low for s in sums]
        heapq.heappush(heap, (-sums[-1], next(tie), sums, parts))
    return heap[0][3] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few windows as differencing gives without exceeding the capacity."""
    k = -(-sum(sizes) // capacity)
    while True:
        found = [w for w in differencing(sizes, k) if w]
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return found
        k += 1


class _Packer:
    def __init__(self, capacity: int, task: int):
        self.capacity, self.next_id = capacity, task << 32
        self.target = max(capacity, int(GROUP * capacity * FILL))
        self.pool: list[tuple] = []
        self.held = 0
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, list] = {f.name: [] for f in SCHEMA.fields}

    def _emit(self, window: list[tuple]) -> None:
        offset = 0
        for doc_id, start, total, ids in window:
            for name, value in (("doc_id", doc_id), ("start", start), ("length", len(ids)), ("doc_tokens", total),
                                ("sequence_id", self.next_id), ("offset", offset), ("ids", ids.tobytes())):
                self.rows[name].append(value)
            offset += len(ids)
        self.next_id += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.capacity:
            self._emit([(doc_id, at, total, ids[at:at + self.capacity])])
            at += self.capacity
        if at < total:
            self._pool(doc_id, at, total, ids[at:])

    def _pool(self, doc_id, start: int, total: int, ids: np.ndarray) -> None:
        room = self.target - self.held
        if len(ids) < room:
            self.pool.append((doc_id, start, total, ids))
            self.held += len(ids)
            return
        self.pool.append((doc_id, start, total, ids[:room]))
        self.flush()
        if len(ids) > room:
            self._pool(doc_id, start + room, total, ids[room:])

    def _fine(self) -> None:
        """Cut the last pieces of the group into small change: merged last, it evens out the sums."""
        wanted, change = CHANGE * -(-self.held // self.capacity), []
        while self.pool and len(change) < wanted:
            doc_id, start, total, ids = self.pool.pop()
            change += [(doc_id, start + k, total, ids[k:k + GRAIN]) for k in range(0, len(ids), GRAIN)]
        self.pool += change

    def flush(self) -> None:
        if self.pool:
            self._fine()
            for window in windows([len(p[3]) for p in self.pool], self.capacity):
                self._emit([self.pool[i] for i in window])
        self.pool, self.held = [], 0


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece with its ids (little-endian uint32) and place in its sequence."""

    def run(batches: Iterator[pa.RecordBatch]):
        encode = encoder(tokenizer_path).encode
        end = np.array([end_id], "<u4").tobytes()
        packer = _Packer(capacity, TaskContext.get().partitionId())
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in portions(texts):
                for doc_id, ids in zip(doc_ids[lo:hi], encode(texts[lo:hi])):
                    packer.add(doc_id, np.frombuffer(ids + end, "<u4"))
                yield packer.rows
                packer.clear()
        packer.flush()
        yield packer.rows

    return tabulate(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), SCHEMA, run)
