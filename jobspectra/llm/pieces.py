"""Exact encoding and decoding with a merge-type (BPE) SentencePiece model by prefix tables.

The encoding of a prefix ends with one token only, so a table of last tokens describes
the encodings of all prefixes. Going left to right, an automaton over the vocabulary
gives the tokens that end at a position; the one that is compatible with the last token
of the prefix in front of it is stored. Two tokens are compatible if merging their joint
text leaves exactly these two. Ids are recovered backwards from the end. The time is
linear in the length of the text whatever it looks like.

Borders that no vocabulary piece spans (in front of a space mark, around characters the
vocabulary does not have, and so on) separate independent segments, which are found for
many texts at once; a worker keeps the ids of segments it has met of late, ``MAX_KEPT`` at about most. Characters outside the vocabulary become
byte tokens. The model must have identity normalization, byte fallback, a dummy space in
front and no removal of spaces; ``Model`` raises otherwise.

A null text counts as empty: the end id only, decoded to an empty text.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain, pairwise

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from jobspectra.llm.tokens import portions
from jobspectra.llm.words import annotate, held_by_worker

MARK = "▁"
MAX_KEPT = 300_000
MAX_KEPT_CHARS = 40
MAX_PAIRS = 400_000


class Model:
    """Vocabulary and merge order of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        bytes_ = {int(self.pieces[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        probes = {" a  b ": " a  b ", "\nａ": "\nａ", "": ""}
        if len(bytes_) != 256 or any(sp.decode(sp.encode(t)) != w for t, w in probes.items()) or sp.encode("a") != sp.encode(" a")[-1:]:
            # " a" is the dummy space, then " a": its last id must be that of "a".
            raise ValueError(f"{path}: not a byte-fallback model with identity normalization")
        self.byte_id = [bytes_[b] for b in range(256)]
        self.joined = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        plain_set = set(plain)
        value = {i: b for b, i in bytes_.items()}
        self.raw = [bytes([value[i]]) if i in value else self.pieces[i].replace(MARK, " ").encode() if i in plain_set else b""
                    for i in range(n)]
        self.reachable = [i for i in plain if self.merge(self.pieces[i]) == [self.pieces[i]]]

    def merge(self, text: str) -> list[str]:
        """The merges themselves: best score first, leftmost among equals. For short texts."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts


class _Segments(dict):
    """Ids of segments, made when a segment is first met. Segments not met again while half as
    many as are kept came in are let go."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, segment: str) -> tuple[int, ...]:
        ids = self.older.get(segment) or self.make(segment)
        if len(segment) <= MAX_KEPT_CHARS:
            self[segment] = ids
        return ids

    def bounded(self) -> None:
        if len(self) > MAX_KEPT // 2:
            self.older = dict(self)
            self.clear()


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str):
        self.model = m = Model(path)
        self.automaton = ahocorasick.Automaton()
        for i in m.reachable:
            self.automaton.add_word(m.pieces[i], (i, len(m.pieces[i])))
        self.automaton.make_automaton()
        self.decimal = [str(i) for i in range(len(m.pieces))]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.segments = _Segments(self.by_table)
        # Characters by number, 0 for those in no pair; pairs in a table whose accidental hits, if
        # there are very many characters, only leave a border out.
        letters = sorted({c for pair in m.joined for c in pair})
        self.kinds = np.zeros(0x110000, np.int64)
        self.kinds[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        self.joined = np.zeros(min(self.width ** 2, 1 << 25), bool)
        first, second = (self.kinds[[ord(pair[k]) for pair in m.joined]] for k in (0, 1))
        self.joined[(first * self.width + second) % len(self.joined)] = True

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            left, right = self.model.pieces[a], self.model.pieces[b]
            known = left + right not in self.model.score and self.model.merge(left + right) == [left, right]
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def by_table(self, segment: str) -> tuple[int, ...]:
        """Ids of a segment from its prefix table."""
        if len(segment) == 1 and segment not in self.model.ids:
            return tuple(self.model.byte_id[b] for b in segment.encode("utf-8", "replace"))
        last: list[tuple[int, int] | None] = [None] * (len(segment) + 1)
        compatible = self.compatible
        for end, token in self.automaton.iter(segment):
            end += 1
            if last[end] is None:
                start = end - token[1]
                if start == 0 or (last[start] is not None and compatible(last[start][0], token[0])):
                    last[end] = token
        out, at = [], len(segment)
        while at:
            token, length = last[at]
            out.append(token)
            at -= length
        return tuple(reversed(out))

    def _cuts(self, text: str, ends: np.ndarray) -> np.ndarray:
        """Borders of segments: between characters that no piece holds side by side, and at ``ends``."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        border = np.zeros(len(codes) + 1, bool)
        border[0] = border[ends] = True
        for lo in range(0, len(codes), 1 << 20):
            kinds = self.kinds[codes[lo:lo + (1 << 20) + 1]]
            left, right = kinds[:-1], kinds[1:]
            joined = self.joined[(left * self.width + right) % len(self.joined)] & (left > 0) & (right > 0)
            border[lo + 1:lo + 1 + len(joined)] |= ~joined
        return np.flatnonzero(border)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, without end id."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        joined = "".join(marked)
        ends = np.cumsum([len(t) for t in marked], dtype=np.int64)
        cuts = self._cuts(joined, ends)
        names = [joined[a:b] for a, b in pairwise(cuts.tolist())]
        self.segments.bounded()
        known, out, at = self.segments.__getitem__, [], 0
        for end in np.searchsorted(cuts, ends).tolist():
            out.append(list(chain.from_iterable(map(known, names[at:end]))))
            at = end
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.model.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    return Codec(path)


held_by_worker(codec.cache_clear)


def encode(docs: DataFrame, model_path: str, end_id: int | None = 2, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the ids of each whole text, the end id last."""

    def run(values: list) -> list[list]:
        c, tail = codec(model_path), [] if end_id is None else [end_id]
        texts = [v or "" for v in values]
        return [[ids + tail for lo, hi in portions(texts) for ids in c.encode_all(texts[lo:hi])]]

    return annotate(docs, text_col, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], run)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """Add the text that the ids stand for; null ids give null."""

    def run(values: list) -> list[list]:
        c = codec(model_path)
        return [[None if v is None else c.decode(v) for v in values]]

    return annotate(rows, ids_col, [T.StructField(text_col, T.StringType())], run)


def digests(docs: DataFrame, model_path: str, end_id: int = 2, text_col: str = "text") -> DataFrame:
    """Round trip in one pass: number of ids, digest of the ids, digest of the decoded text."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]

    def run(values: list) -> list[list]:
        c = codec(model_path)
        out: list[list] = [[], [], []]
        texts = [v or "" for v in values]
        for lo, hi in portions(texts):
            for ids in c.encode_all(texts[lo:hi]):
                ids.append(end_id)
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                out[2].append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        return out

    return annotate(docs, text_col, fields, run)
