"""Token files: ids in independently coded, checksummed blocks of an adaptive range coder.

A block holds whole documents. Its ids are dealt to lanes of ``STEPS`` ids that follow each
other; all lanes take a step at a time, so both directions work on arrays. For each id an
order-2 table (by the two ids before) and an order-1 table (by the one before) each predict
one id with a confidence from 0 to 7. How often each is right, by both confidences, is
counted while coding; that share of the range goes to either prediction, the rest to
the order-0 frequencies of all ids so far. Tables are brought up to date after every
step, frequencies after every few. Nothing is kept from one block to the next, so a block
can be read alone; its header has the document ids, their lengths, and a checksum of the
ids that is verified on reading.

Ids are below 65536. Files are Parquet tables of blocks, written by Spark's own committer:
a task that is lost and run again leaves no partial block. Documents are in ascending
order of their id, null ids first; a null text is empty and has the end id only.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobspectra.llm.tokens import encoder, portions
from jobspectra.llm.words import tabulate

IDS = 1 << 16
STEPS = 512
BLOCK_TOKENS = 1 << 21
MAGIC = 0x314B4254

_CHOICE, _ZERO = 12, 17  # bits of the choice among predictions and of the frequencies
_BITS = np.uint64(_CHOICE + _ZERO)
_WORD = np.uint64(32)
_LOW = np.uint64(1 << 32)
_HASH = 20
#: What a table entry changes by, by its confidence: halved if it was wrong (below 2 it is replaced), one more if right.
_CHANGE = np.array([(c >> 1) - c for c in range(8)] + [int(c < 7) for c in range(8)], np.int32)


class _Predictor:
    """What both directions know before a step; ``learn`` after it.

    A table entry is the predicted id and its confidence in the three low bits.
    """

    def __init__(self, lanes: int):
        self.one, self.two = np.zeros(IDS, np.int32), np.zeros(1 << _HASH, np.int32)
        self.outcomes = np.tile(np.array([0.1, 0.1, 1.0]), (64, 1))
        self.counts = np.zeros(IDS, np.int64)
        self.before = np.zeros(lanes, np.int64)
        self.before_two = np.zeros(lanes, np.int64)
        self.step = 0
        self.new: list[np.ndarray] = []
        self.tally = np.zeros(192, np.int64)
        self._frequencies()
        self._shares()

    def _frequencies(self) -> None:
        """Every id has at least one slot of 2^17."""
        if self.counts.any():
            cum = np.concatenate(([0], np.cumsum(self.counts))) * ((1 << _ZERO) - IDS) // int(self.counts.sum())
            start = cum + np.arange(IDS + 1)
        else:
            start = np.arange(IDS + 1) * 2
        # Nothing made of these exceeds 2^29, so 32 bits do.
        self.start = start.astype(np.int32)
        self.width = np.diff(self.start)
        self.slots = None

    def _shares(self) -> None:
        self.outcomes += self.tally.reshape(64, 3)
        self.tally[:] = 0
        rate = self.outcomes / self.outcomes.sum(axis=1, keepdims=True)
        size = 1 << _CHOICE
        self.first = np.clip((rate[:, 0] * size).astype(np.int32), 1, size - 66)
        self.second = np.clip((rate[:, 1] * size).astype(np.int32), 1, size - 64 - self.first)

    def predict(self) -> None:
        self.at = ((self.before_two * 0x9E3779B1 + self.before * 0x85EBCA6B) >> 7) & ((1 << _HASH) - 1)
        self.v2, self.v1 = self.two.take(self.at), self.one.take(self.before)
        self.p2, self.p1 = self.v2 >> 3, self.v1 >> 3
        self.mixed = ((self.v2 & 7) << 3) | (self.v1 & 7)
        self.f2, self.f1 = self.first.take(self.mixed), self.second.take(self.mixed)
        self.f1 *= self.p1 != self.p2
        self.both = self.f2 + self.f1

    def interval(self, ids: np.ndarray, two: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the ids within 2^29, given which prediction holds."""
        rest = (1 << _CHOICE) - self.both
        start = self.both << _ZERO
        start += self.start.take(ids) * rest
        size = self.width.take(ids)
        size *= rest
        np.copyto(start, self.f2 << _ZERO, where=one)
        np.copyto(size, self.f1 << _ZERO, where=one)
        np.copyto(start, 0, where=two)
        np.copyto(size, self.f2 << _ZERO, where=two)
        return start.astype(np.uint64), size.astype(np.uint64)

    def learn(self, ids: np.ndarray, two: np.ndarray, one: np.ndarray) -> None:
        small = ids.astype(np.int32)
        fresh = small << 3
        for table, at, v, right in ((self.two, self.at, self.v2, two), (self.one, self.before, self.v1, self.p1 == small)):
            state = v & 7
            state += right.view(np.int8) << 3
            now = _CHANGE.take(state)
            now += v
            np.copyto(now, fresh, where=state < 2)
            table[at] = now
        outcome = self.mixed * 3
        outcome += 2
        outcome -= two.view(np.int8) << 1
        outcome -= one.view(np.int8)
        self.tally += np.bincount(outcome, minlength=192)
        self.before_two, self.before = self.before, ids
        self.new.append(ids)
        self.step += 1
        if self.step & (self.step - 1) == 0 or self.step % 32 == 0:
            self.counts += np.bincount(np.concatenate(self.new), minlength=IDS)
            self.new = []
            self._frequencies()
        if self.step < 16 or self.step % 8 == 0:
            self._shares()


def _settled(low: np.ndarray, span: np.ndarray, shift) -> None:
    """Move lanes on by 32 bits whose upper bits are settled, or whose range has become
    narrow (it is cut at the border it lies across); ``shift`` sees them first."""
    top = low + span
    top ^= low
    np.minimum(top, span, out=top)
    rows = np.flatnonzero(top < _LOW)
    if len(rows):
        a, b = low.take(rows), span.take(rows)
        across = (a ^ (a + b)) >= _LOW
        if across.any():
            b[across] = (~a[across] + np.uint64(1)) & (_LOW - np.uint64(1))
        shift(rows, a)
        low[rows] = a << _WORD
        span[rows] = b << _WORD


def encode_ids(ids: np.ndarray) -> bytes:
    """Code ids (below 65536) as the payload of a block."""
    lanes = max(1, -(-len(ids) // STEPS))
    grid = np.zeros(lanes * STEPS, np.uint16)
    grid[:len(ids)] = ids
    steps = min(STEPS, len(ids)) if lanes == 1 else STEPS
    grid = np.ascontiguousarray(grid.reshape(lanes, STEPS).T)
    model = _Predictor(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    words, used = np.zeros((lanes, STEPS + 8), np.uint32), np.zeros(lanes, np.int64)

    flat = words.reshape(-1)

    def emit(rows: np.ndarray, lows: np.ndarray) -> None:
        at = used.take(rows)
        flat[rows * words.shape[1] + at] = lows >> _WORD
        used[rows] = at + 1

    for t in range(steps):
        now = grid[t].astype(np.int64)
        model.predict()
        two = model.p2 == now
        one = (model.p1 == now) & ~two
        start, size = model.interval(now, two, one)
        span >>= _BITS
        low += span * start
        span *= size
        _settled(low, span, emit)
        model.learn(now, two, one)
    every = np.arange(lanes)
    for _ in range(2):
        emit(every, low)
        low <<= _WORD
    mask = np.arange(words.shape[1])[None, :] < used[:, None]
    return used.astype("<u2").tobytes() + words[mask].astype("<u4").tobytes()


def decode_ids(data: bytes, n: int) -> np.ndarray:
    """The ids of a block's payload."""
    lanes = max(1, -(-n // STEPS))
    steps = min(STEPS, n) if lanes == 1 else STEPS
    used = np.frombuffer(data, "<u2", lanes).astype(np.int64)
    stream = np.concatenate((np.frombuffer(data[2 * lanes:], "<u4"), np.zeros(2, np.uint32))).astype(np.uint64)
    at = np.concatenate(([0], np.cumsum(used)[:-1]))
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    code = (stream[at] << _WORD) | stream[at + 1]
    at += 2

    def refill(rows: np.ndarray, lows: np.ndarray) -> None:
        here = at.take(rows)
        code[rows] = (code.take(rows) << _WORD) | stream.take(here, mode="clip")
        at[rows] = here + 1

    model = _Predictor(lanes)
    grid = np.zeros((STEPS, lanes), np.uint16)
    for t in range(steps):
        model.predict()
        if model.slots is None:
            model.slots = np.repeat(np.arange(IDS, dtype=np.uint16), model.width)
        span >>= _BITS
        value = np.minimum(_quotient(code - low, span), (1 << (_CHOICE + _ZERO)) - 1)
        choice = value >> _ZERO
        two = choice < model.f2
        one = (choice < model.both) & ~two
        # Exact: both numbers are far below 2^53.
        slot = ((value - (model.both << _ZERO)) / ((1 << _CHOICE) - model.both)).astype(np.int64)
        now = model.slots.take(np.maximum(slot, 0)).astype(np.int64)
        np.copyto(now, model.p1, where=one)
        np.copyto(now, model.p2, where=two)
        start, size = model.interval(now, two, one)
        low += span * start
        span *= size
        _settled(low, span, refill)
        grid[t] = now
        model.learn(now, two, one)
    return grid.T.ravel()[:n].astype(np.uint32)


def _quotient(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a // b for quotients below 2^30, by way of doubles."""
    q = (a.astype(np.float64) / b.astype(np.float64)).astype(np.int64)
    product = q.view(np.uint64) * b
    q -= product > a
    q += (a - q.view(np.uint64) * b) >= b
    return q


def write_block(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """A self-contained block: header, documents, coded ids."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = np.array([MAGIC, len(doc_ids), len(ids), zlib.crc32(ids.astype("<u4").tobytes())], "<u4")
    body = zlib.compress(known.tobytes() + np.diff(numbers, prepend=0).astype("<i8").tobytes() + np.array(lengths, "<u4").tobytes(), 1)
    return head.tobytes() + np.array([len(body)], "<u4").tobytes() + body + encode_ids(ids)


def read_block(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, lengths, ids) of a block; raises if it is damaged."""
    magic, docs, n, crc, size = (int(x) for x in np.frombuffer(data, "<u4", 5))
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    body = zlib.decompress(data[20:20 + size])
    known = np.frombuffer(body, np.uint8, docs)
    numbers = np.cumsum(np.frombuffer(body, "<i8", docs, docs))
    lengths = np.frombuffer(body, "<u4", docs, 9 * docs)
    ids = decode_ids(data[20 + size:], n)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of a block does not hold")
    return [int(v) if k else None for k, v in zip(known, numbers)], lengths, ids


BLOCKS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("tokens", T.LongType()),
                       T.StructField("block", T.BinaryType())])


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of whole texts, each closed by ``end_id``, in ascending order of document.

    Rows of equal id are ordered by a hash of their texts, so that their places are fixed and
    many of them can lie in several parts; a null id comes first.
    """

    def run(batches):
        encode, part, before = encoder(tokenizer_path).encode_flat, TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        names: list = []
        held: list[np.ndarray] = []
        lengths: list[int] = []
        size = 0
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in portions(texts):
                ids, sizes = encode(texts[lo:hi])
                at = 0
                for doc_id, n in zip(doc_ids[lo:hi], sizes.tolist()):
                    names.append(doc_id)
                    held += (ids[at:at + n], end)
                    lengths.append(n + 1)
                    at += n
                    size += n + 1
                    if size >= BLOCK_TOKENS:
                        yield _row(part, before, names, lengths, held, size)
                        before, names, lengths, held, size = before + size, [], [], [], 0
        if names:
            yield _row(part, before, names, lengths, held, size)

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = ordered.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    tabulate(ordered, BLOCKS, run).write.parquet(path)


def _row(part: int, before: int, names: list, lengths: list[int], held: list[np.ndarray], size: int) -> dict:
    return {"part": [part], "before": [before], "tokens": [size], "block": [write_block(names, lengths, np.concatenate(held))]}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of token files: doc_id, start (ids of all documents before it), n_tokens, ids (uint32)."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # One row per part of the files.
    totals = blocks.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()
    offsets, at = [], 0
    for r in totals:
        offsets.append((r.part, at))
        at += r.n
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                names, lengths, ids = read_block(row["block"])
                raw, starts = ids.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(lengths.astype(np.int64))))
                for lo in range(0, len(names), 2048):
                    hi = min(lo + 2048, len(names))
                    yield {"part": [row["part"]] * (hi - lo), "doc_id": names[lo:hi], "start": (starts[lo:hi] + row["before"]).tolist(),
                           "n_tokens": lengths[lo:hi].astype(np.int64), "ids": [raw[4 * starts[i]:4 * starts[i + 1]] for i in range(lo, hi)]}

    known = spark.createDataFrame(offsets, "part int, earlier long")
    found = tabulate(blocks.select("part", "before", "block"), schema, run).join(F.broadcast(known), "part")
    return found.select("doc_id", (F.col("start") + F.col("earlier")).alias("start"), "n_tokens", "ids")
