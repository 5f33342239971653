"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted arrays
that workers map into memory.

Texts are lower-cased (A-Z), cut into words and closed by an end token. The model lies in
the shared folder as one file per array and shard:

* vocabulary: sorted 64-bit word hashes; a word's id is its place. Beside them the word's
  count, the numbers of words that follow it once, twice and more often, and the number
  of different words in front of it;
* bigrams: sorted keys (id of the first word, id of the second) and their counts.

Counting is map-side combined: a task sends each shard its sorted distinct keys with
counts, packed; so a frequent word or pair arrives once per task. The bigrams of a word
lie in one shard, those of a frequent word in several (by its count), so shards are even.
The number of shards follows the number of input splits. Only sums (counts of counts,
totals, shard sizes) come to the driver. Scoring maps the arrays, looks up the sorted
distinct words and pairs of a block of texts, and shuffles nothing.

Null and empty texts are one end token. Without training rows every word is unknown and
the model is uniform over the unknown word.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobspectra.llm.words import Block, annotate, blocks, mix, tabulate
from jobspectra.session import shared_dir

#: Not a word's: the word hashes of these are reserved.
END = np.uint64(0xE5D0_0000_0000_0001)
BEGIN, UNKNOWN = 0xFFFF_FFFF, 0xFFFF_FFFE
FLUSH = 1 << 22
#: A word with more than this share of a shard's tokens is dealt out to several shards.
PIECE = 0.25

PAYLOAD = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("data", T.BinaryType())])


def _pack(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Sorted keys as differences, and values of 64 bits; bytes of one weight lie together, so unused ones shrink to nothing."""
    parts = [np.diff(keys, prepend=np.zeros(1, keys.dtype)).view(np.uint8).reshape(len(keys), -1).T.tobytes()]
    parts += [v.astype("<i8").view(np.uint8).reshape(len(keys), -1).T.tobytes() for v in values]
    return np.array([len(keys)], "<u8").tobytes() + zstandard.ZstdCompressor(1).compress(b"".join(parts))


def _unpack(data: bytes, columns: int) -> list[np.ndarray]:
    n = int(np.frombuffer(data[:8], "<u8")[0])
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=8 * n * (1 + columns) + 64), np.uint8)
    keys = np.cumsum(np.ascontiguousarray(raw[:8 * n].reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)
    out = [keys]
    for c in range(columns):
        at = 8 * n * (1 + c)
        out.append(np.ascontiguousarray(raw[at:at + 8 * n].reshape(8, n).T).view(np.int64).ravel())
    return out


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct keys with the sums of their values."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return [keys[first], *(np.add.reduceat(v[order], first) for v in values)]


class _Counts:
    """Distinct keys of a task; handed on when there are ``FLUSH`` of them."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.held.append(np.unique(keys, return_counts=True))
        self.size += len(self.held[-1][0])

    def full(self) -> bool:
        if self.size > 2 * FLUSH:
            self.held = [tuple(self.take())]
            self.size = len(self.held[0][0])
        return self.size > FLUSH

    def take(self) -> list[np.ndarray]:
        if not self.held:
            return [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        out = _summed(*(np.concatenate(x) for x in zip(*self.held)))
        self.held, self.size = [], 0
        return out


def _rows(kind: str, shard: np.ndarray, shards: int, keys: np.ndarray, *values: np.ndarray) -> dict:
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    out: dict[str, list] = {"shard": [], "kind": [], "data": []}
    for s in range(shards):
        part = order[cuts[s]:cuts[s + 1]]
        if len(part):
            out["shard"].append(s)
            out["kind"].append(kind)
            out["data"].append(_pack(keys[part], *(v[part] for v in values)))
    return out


def _word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _stream(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a block, the end of each text included, and each one's text."""
    at = np.arange(len(block.starts)) + block.doc
    out = np.full(len(block.starts) + block.n_docs, END)
    out[at] = block.hashes()
    return out, np.repeat(np.arange(block.n_docs), block.n_words + 1)


def _save(uri: str, array: np.ndarray) -> None:
    """Whole or not at all, so a task that runs again does no harm."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(np.ascontiguousarray(array).tobytes())
    system.move(part, path)


@lru_cache(maxsize=4096)
def _mapped(uri: str, kind: str) -> np.ndarray:
    """An array of the model, mapped where the shared folder is mounted, else read from its store."""
    system, path = fs.FileSystem.from_uri(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound or not info.size:
        return np.zeros(0, kind)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


@dataclass
class Vocabulary:
    folder: str
    starts: list[int]  # first id of each shard

    @property
    def shards(self) -> int:
        return len(self.starts)

    def column(self, name: str, kind: str, shard: int) -> np.ndarray:
        return _mapped(f"{self.folder}/{name}-{shard}", kind)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes."""
        out = np.full(len(hashes), UNKNOWN, np.int64)
        cuts = np.searchsorted(_word_shard(hashes, self.shards), np.arange(self.shards + 1))
        for s in range(self.shards):
            part = hashes[cuts[s]:cuts[s + 1]]
            known = self.column("hashes", "<u8", s)
            if len(part) and len(known):
                at = np.minimum(np.searchsorted(known, part), len(known) - 1)
                out[cuts[s]:cuts[s + 1]] = np.where(known[at] == part, at + self.starts[s], UNKNOWN)
        return out

    def values(self, ids: np.ndarray, names: dict[str, str]) -> list[np.ndarray]:
        """Columns at ids that ascend; 0 at reserved ids."""
        out = [np.zeros(len(ids), np.int64) for _ in names]
        cuts = np.searchsorted(ids, [*self.starts, UNKNOWN])
        for s in range(self.shards):
            if cuts[s + 1] > cuts[s]:
                for held, (name, kind) in zip(out, names.items()):
                    column = self.column(name, kind, s)
                    if len(column):
                        held[cuts[s]:cuts[s + 1]] = column[ids[cuts[s]:cuts[s + 1]] - self.starts[s]]
        return out


@dataclass
class Model:
    vocabulary: Vocabulary
    texts: int
    tokens: int
    types: int
    discounts: tuple[float, float, float]  # of bigrams seen once, twice, more often
    lower: tuple[float, float, float]  # of words with one, two, more words in front
    fronts: int  # different bigrams
    lower_rest: float  # what the lower order leaves to the uniform distribution
    begin: tuple[int, int, int]  # words that begin texts once, twice, more often


def _pieces(count: np.ndarray, tokens: int, shards: int) -> np.ndarray:
    return np.maximum(1, np.ceil(count * shards / max(1.0, tokens * PIECE))).astype(np.int64)


def _pair_shard(first: np.ndarray, second: np.ndarray, pieces: np.ndarray, shards: int) -> np.ndarray:
    spread = mix(second.astype(np.uint64) + np.uint64(77)) % pieces.astype(np.uint64)
    return _word_shard(mix(first.astype(np.uint64) * np.uint64(4099) + spread), shards)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5  # too little data to estimate them
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))


def _pairs(vocabulary: Vocabulary, texts: int, tokens: int, block: Block):
    """(ids, text of each token, first ids, keys) of a block."""
    hashes, doc = _stream(block)
    distinct, back = np.unique(hashes, return_inverse=True)
    known = vocabulary.ids(distinct)
    ids = known[back]
    first = np.concatenate(([BEGIN], ids[:-1]))
    first[1:][doc[1:] != doc[:-1]] = BEGIN
    return distinct, known, back, ids, doc, first


def _first_counts(vocabulary: Vocabulary, texts: int, first: np.ndarray) -> np.ndarray:
    """How often each (ascending) first id begins a pair."""
    count = vocabulary.values(first, {"counts": "<i8"})[0]
    return np.where(first == BEGIN, texts, count)


def _qualified(spark: SparkSession, folder: str) -> str:
    """A path without a scheme lies where the cluster's default file system is, as Spark's own tables do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Count the texts and store the model in the shared folder."""
    spark = docs.sparkSession
    folder = _qualified(spark, f"{shared_dir(spark)}/text-{uuid.uuid4().hex}/ngrams")
    texts = docs.select(text_col)
    shards = max(1, texts.rdd.getNumPartitions())
    sizes = T.StructType([T.StructField("shard", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in "abcdefgh"]])

    def words(batches):
        counts = _Counts()
        for batch in batches:
            for _, _, block in blocks(batch.column(0).to_pylist(), True):
                counts.add(_stream(block)[0])
                if counts.full():
                    keys, n = counts.take()
                    yield _rows("words", _word_shard(keys, shards), shards, keys, n)
        keys, n = counts.take()
        yield _rows("words", _word_shard(keys, shards), shards, keys, n)

    def save_words(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _summed(*(np.concatenate(x) for x in zip(*(_unpack(b, 1) for b in table.column("data").to_pylist()))))
        _save(f"{folder}/hashes-{shard}", keys.astype("<u8"))
        _save(f"{folder}/counts-{shard}", counts.astype("<i8"))
        ends = int(counts[keys == END].sum())
        return _sizes(shard, len(keys), int(counts.sum()), ends)

    def _sizes(shard, *numbers) -> pa.Table:
        numbers = [*numbers, *[0] * (8 - len(numbers))]
        return pa.table({"shard": pa.array([shard], pa.int32()), **{n: pa.array([v], pa.int64()) for n, v in zip("abcdefgh", numbers)}})

    found = {r.shard: r for r in tabulate(texts, PAYLOAD, words).groupBy("shard").applyInArrow(save_words, sizes).collect()}
    lens = [found[s].a if s in found else 0 for s in range(shards)]
    types, tokens, n_texts = sum(lens), sum(r.b for r in found.values()), sum(r.c for r in found.values())
    vocabulary = Vocabulary(folder, [int(x) for x in np.concatenate(([0], np.cumsum(lens)[:-1]))])
    if types >= UNKNOWN:
        raise ValueError("more distinct words than ids")

    def pairs(batches):
        counts = _Counts()

        def rows():
            keys, n = counts.take()
            first, second = keys >> np.uint64(32), keys & np.uint64(0xFFFF_FFFF)
            pieces = _pieces(_first_counts(vocabulary, n_texts, first.astype(np.int64)), tokens, shards)
            return _rows("pairs", _pair_shard(first, second, pieces, shards), shards, keys, n)

        for batch in batches:
            for _, _, block in blocks(batch.column(0).to_pylist(), True):
                *_, ids, _, first = _pairs(vocabulary, n_texts, tokens, block)
                counts.add((first.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64))
                if counts.full():
                    yield rows()
        yield rows()

    def save_pairs(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _summed(*(np.concatenate(x) for x in zip(*(_unpack(b, 1) for b in table.column("data").to_pylist()))))
        _save(f"{folder}/pairs-{shard}", keys.astype("<u8"))
        _save(f"{folder}/pair_counts-{shard}", counts.astype("<i8"))
        first = (keys >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        after = [np.add.reduceat((counts == k) if k < 3 else (counts >= 3), starts).astype(np.int64) for k in (1, 2, 3)]
        second, front = np.unique(keys & np.uint64(0xFFFF_FFFF), return_counts=True)
        sums = np.array([*(int((counts == k).sum()) for k in (1, 2, 3, 4)), len(keys)], np.int64)
        begins = first[starts] == BEGIN
        begin = np.array([int(a[begins].sum()) for a in after], np.int64)
        ids = first[starts].astype(np.uint64)
        shares = _rows("after", _id_shard(ids[~begins], vocabulary), vocabulary.shards, ids[~begins], *(a[~begins] for a in after))
        fronts = _rows("front", _id_shard(second, vocabulary), vocabulary.shards, second, front)
        return pa.table({"shard": pa.array([*shares["shard"], *fronts["shard"], -1], pa.int32()),
                         "kind": [*shares["kind"], *fronts["kind"], "sums"],
                         "data": pa.array([*shares["data"], *fronts["data"], np.concatenate([sums, begin]).tobytes()], pa.binary())})

    def save_shares(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        kinds, data = table.column("kind").to_pylist(), table.column("data").to_pylist()
        if shard < 0:
            total = sum((np.frombuffer(b, np.int64) for b in data), np.zeros(8, np.int64))
            return _sizes(shard, *total.tolist())
        start, n = vocabulary.starts[shard], lens[shard]
        columns = [np.zeros(n, np.int64) for _ in range(4)]
        for kind, packed in zip(kinds, data):
            if kind == "after":
                keys, *values = _unpack(packed, 3)
                for held, v in zip(columns, values):
                    held[keys.astype(np.int64) - start] += v
            else:
                keys, v = _unpack(packed, 1)
                columns[3][keys.astype(np.int64) - start] += v
        for name, column in zip(("after1", "after2", "after3", "fronts"), columns):
            _save(f"{folder}/{name}-{shard}", column.astype("<u4"))
        a = columns[3]
        return _sizes(shard, *(int((a == k).sum()) for k in (1, 2, 3, 4)), int((a >= 3).sum()))

    halves = tabulate(texts, PAYLOAD, pairs).groupBy("shard").applyInArrow(save_pairs, PAYLOAD)
    sums, front = np.zeros(8, np.int64), np.zeros(5, np.int64)
    for r in halves.groupBy("shard").applyInArrow(save_shares, sizes).collect():
        if r.shard < 0:
            sums = np.array([r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h], np.int64)
        else:
            front += np.array([r.a, r.b, r.c, r.d, r.e], np.int64)
    lower = _discounts(front[:4].tolist())
    distinct = int(sums[4])
    rest = (lower[0] * front[0] + lower[1] * front[1] + lower[2] * front[4]) / distinct if distinct else 1.0
    return Model(vocabulary, n_texts, tokens, types, _discounts(sums[:4].tolist()), lower, distinct, float(rest), tuple(int(x) for x in sums[5:]))


def _id_shard(ids: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    return np.searchsorted(np.array(vocabulary.starts, np.int64), ids.astype(np.int64), "right") - 1


def _less(count: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(count - np.choose(np.minimum(count, 3), (0.0, *discounts)), 0.0)


def _score_block(model: Model, block: Block) -> tuple[np.ndarray, ...]:
    vocabulary = model.vocabulary
    _, known, back, ids, doc, first = _pairs(vocabulary, model.texts, model.tokens, block)
    # ``known`` ascends but for unknown words: its order serves the look-ups by word.
    order = np.argsort(known, kind="stable")
    names = {"counts": "<i8", "after1": "<u4", "after2": "<u4", "after3": "<u4", "fronts": "<u4"}
    count, one, two, more, fronts = (np.empty_like(v) for v in (known,) * 5)
    for held, v in zip((count, one, two, more, fronts), vocabulary.values(known[order], names)):
        held[order] = v
    base = np.log10((count + 1.0) / (model.tokens + model.types + 1.0))
    lower = model.lower_rest / (model.types + 1.0)
    if model.fronts:
        lower = lower + _less(fronts, model.lower) / model.fronts
    lower = np.broadcast_to(lower, count.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(count > 0, (model.discounts[0] * one + model.discounts[1] * two + model.discounts[2] * more) / count, 1.0)
    n_docs = block.n_docs
    # The first word of each pair is the token before; a text's first pair starts at its begin.
    total = np.where(first == BEGIN, model.texts, np.concatenate(([0], count[back][:-1])))
    begin = float(np.dot(model.discounts, model.begin)) / model.texts if model.texts else 1.0
    weight = np.where(first == BEGIN, begin, np.concatenate(([1.0], left[back][:-1])))
    keys, at = np.unique((first.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64), return_inverse=True)
    found = _pair_counts(model, keys)[at]
    p = weight * lower[back]
    seen = found > 0
    p[seen] += _less(found[seen], model.discounts) / total[seen]
    n = np.bincount(doc, minlength=n_docs)
    return (n, np.bincount(doc, count[back] > 0, n_docs).astype(np.int64), np.bincount(doc, base[back], n_docs),
            np.bincount(doc, np.log10(p), n_docs))


def _pair_counts(model: Model, keys: np.ndarray) -> np.ndarray:
    """Counts of sorted distinct pairs."""
    vocabulary, out = model.vocabulary, np.zeros(len(keys), np.int64)
    first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFF_FFFF)).astype(np.int64)
    possible = np.flatnonzero((first != UNKNOWN) & (second != UNKNOWN))
    first, second, keys = first[possible], second[possible], keys[possible]
    pieces = _pieces(_first_counts(vocabulary, model.texts, first), model.tokens, vocabulary.shards)
    shard = _pair_shard(first, second, pieces, vocabulary.shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(vocabulary.shards + 1))
    for s in range(vocabulary.shards):
        part = order[cuts[s]:cuts[s + 1]]
        have = vocabulary.column("pairs", "<u8", s)
        if len(part) and len(have):
            place = np.minimum(np.searchsorted(have, keys[part]), len(have) - 1)
            hit = have[place] == keys[part]
            out[possible[part[hit]]] = vocabulary.column("pair_counts", "<i8", s)[place[hit]]
    return out


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (log10 probability).

    Perplexity of a text is 10 ** (-score / n_tokens).
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
              T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]

    def run(values: list) -> list[list]:
        out: list[list] = [[] for _ in fields]
        for lo, hi, block in blocks(values, True):
            n, known, base, full = _score_block(model, block)
            for held, more in zip(out, (n, known, np.full(hi - lo, model.tokens), base, full)):
                held.extend(more.tolist())
        return out

    return annotate(docs, text_col, fields, run)
