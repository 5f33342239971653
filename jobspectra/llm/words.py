"""Vectorized words of texts: spans, 64-bit hashes and word n-grams of a block of texts.

A word is a maximal run of characters other than space and \\t \\n \\v \\f \\r. Blocks hold
about two megabytes of text (a longer text is a block of its own), so the working
arrays of a task stay at a few hundred megabytes at most whatever the batch size is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BLOCK_BYTES = 1 << 21
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Block:
    """Words of some texts. ``starts``/``lens`` in bytes of ``data``; ``doc`` per word."""

    def __init__(self, texts: list[bytes], lower: bool, between: np.ndarray = _WHITE):
        joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.doc_starts = np.concatenate(([0], np.cumsum(sizes)))
        self.n_docs = len(texts)
        self.white = between[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], self.white)).astype(np.int8)))
        self.starts, ends = edge[0::2], edge[1::2]
        self.lens = ends - self.starts
        self.doc = np.searchsorted(self.doc_starts, self.starts, "right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)
        self.first_word = np.concatenate(([0], np.cumsum(self.n_words)))

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array by text."""
        return np.add.reduceat(flags.astype(np.int64), self.doc_starts[:-1])

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        return self.prefix_hashes(None)

    def prefix_hashes(self, n: int | None) -> np.ndarray:
        """64-bit hash of the first n bytes of each word, of the whole word if it is shorter."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.lens if n is None else np.minimum(self.lens, n)
        first = np.concatenate(([0], np.cumsum(lens)[:-1]))
        at = np.arange(int(lens.sum())) - np.repeat(first, lens)
        powers = np.full(int(lens.max()), _P)
        np.multiply.accumulate(powers, out=powers)
        letters = self.data[np.repeat(self.starts, lens) + at].astype(np.uint64) + np.uint64(1)
        return mix(np.add.reduceat(letters * powers[at], first) + lens.astype(np.uint64))

    def ngrams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word windows and the index of each one's first word."""
        if len(hashes) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        last = len(hashes) - n + 1
        total = np.zeros(last, np.uint64)
        for k in range(n):
            total = mix(total + hashes[k:last + k] * np.uint64(2 * k + 1))
        at = np.flatnonzero(self.doc[:last] == self.doc[n - 1:])
        return total[at], at


def blocks(texts: list[str | None], lower: bool, between: np.ndarray = _WHITE) -> Iterator[tuple[int, int, Block]]:
    """(from, to, block) over texts; a null text counts as empty. ``between`` marks the
    bytes that are not part of words."""
    held: list[bytes] = []
    size = start = 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "replace")
        if held and size + len(raw) > BLOCK_BYTES:
            yield start, i, Block(held, lower, between)
            held, size, start = [], 0, i
        held.append(raw)
        size += len(raw)
    if held:
        yield start, len(texts), Block(held, lower, between)


_drops: list[Callable[[], None]] = []
_owner = ""


def held_by_worker(drop: Callable[[], None]) -> None:
    """Register how to drop what a worker process keeps between tasks of one operator."""
    _drops.append(drop)


def _begin(owner: str) -> None:
    """A worker that turns to another operator lets go of what the last one kept."""
    global _owner
    if owner != _owner:
        for drop in _drops:
            drop()
        _owner = owner


def hand_back() -> None:
    """Hand freed memory back: workers stay alive between tasks, and there may be several a core;
    so does the driver between steps."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def annotate(df: DataFrame, column: str, fields: list[T.StructField], fn: Callable[[list], list[list]]) -> DataFrame:
    """Append columns computed from one column, batch by batch, with no shuffle.

    ``fn`` gets the values of a batch and returns one list per field. An input column
    with the name of a result column is replaced by it.
    """
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *fields])
    arrow = to_arrow_schema(T.StructType(fields))
    wanted = [f.name for f in kept]

    owner = fn.__module__

    def run(batches):
        _begin(owner)
        for batch in batches:
            values = fn(batch.column(column).to_pylist())
            columns = [batch.column(n) for n in wanted]
            columns += [pa.array(v, f.type) for v, f in zip(values, arrow)]
            yield pa.RecordBatch.from_arrays(columns, names=[*wanted, *arrow.names])
            del values, columns
        hand_back()

    return df.mapInArrow(run, schema)


def tabulate(df: DataFrame, schema: T.StructType, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """Map partitions to new rows; ``fn`` yields one dict of equally long lists at a time."""
    arrow, owner = to_arrow_schema(schema), fn.__module__

    def run(batches):
        _begin(owner)
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], names=arrow.names)
        hand_back()

    return df.mapInArrow(run, schema)
