"""Token ids of whole texts by the ``tokenizers`` library, each distinct word encoded once.

Both kinds of tokenizer files in use (byte-level with the usual word pattern, and lower
case with word ends) never join characters across a border in front of a space that
follows a character other than white space or precedes one. So a text is the
concatenation of its space-led units, and a worker keeps the ids of the units it has
seen, up to ``MAX_UNITS`` from one portion to the next, so memory is bounded.
A file with another pre-tokenizer is used on whole texts.

A lower-case file that drops white space joins nothing across it either, nor between
letters, digits and marks. So texts of Latin-1 characters are cut into these at once, in
arrays of bytes; each distinct one of a block is looked up once, and those that are new go
to the library's merges in one call.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

from jobspectra.llm.words import held_by_worker

MAX_UNITS = 700_000
MAX_UNIT_CHARS = 200
MAX_CHARS = 24_000_000
_DOUBTFUL = re.compile(r"\s (?:\s|$)")
_MARKS = ".,!?;:#$%&*"
_BORDER = re.compile(r"(?<=\S)(?= \S)")
_LOWER_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letter() -> list[str]:
    """Bytes as byte-level tokenizers write them: printable bytes stand for themselves, the
    others for the characters from U+0100 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in own}
    letter |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in letter)}
    return [letter[b] for b in range(256)]


_BYTE = _byte_letter()
_BYTES = {c: "".join(_BYTE[b] for b in chr(c).encode()) for c in range(0x250)}


class _Units(dict):
    """Ids of units, asked for when a unit is first met."""

    def __init__(self, ask):
        super().__init__()
        self.ask, self.chars = ask, 0

    def __missing__(self, unit: str) -> bytes:
        ids = self.ask(unit)
        # Pairs of words across a line feed hardly come again.
        if "\n" not in unit:
            self.chars += len(unit)
            self[unit] = ids
        return ids

    def bounded(self, latest) -> None:
        """Lets go of units if there are too many: of those with marks first, as they are soon put
        together again, then of all but the latest ones. Very long units are not kept."""
        if len(self) <= MAX_UNITS and self.chars <= MAX_CHARS:
            return
        kept = {u: i for u, i in self.items() if u.isalpha() and len(u) <= MAX_UNIT_CHARS}
        if len(kept) > MAX_UNITS * 3 // 4 or sum(map(len, kept)) > MAX_CHARS * 3 // 4:
            latest = {u for units in latest for u in units if len(u) <= MAX_UNIT_CHARS}
            kept = {u: i for u, i in self.items() if u in latest}
        self.clear()
        self.update(kept)
        self.chars = sum(map(len, kept))


class _Words(dict):
    """Lower-case words, digits and runs of marks: from each to its place in ``starts`` and ``sizes``, which
    tell where its ids lie in ``flat``."""

    def __init__(self, ask):
        super().__init__()
        self.ask, self.chars, self.turn = ask, 0, 0
        self.flat, self.starts, self.sizes, self.used = (np.zeros(0, t) for t in (np.uint32, np.int64, np.int64, np.int64))

    def places(self, words: list[str], odd: np.ndarray) -> np.ndarray:
        """Of distinct words; the unknown ones are asked for together."""
        self.turn += 1
        at = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            new = new[np.argsort(odd[new], kind="stable")]
            names, first = [words[i] for i in new.tolist()], len(self)
            ids, sizes = self.ask(names, len(new) - int(odd[new].sum()))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.flat = np.concatenate((self.flat, ids))
            self.used = np.concatenate((self.used, np.zeros(len(new), np.int64)))
            self.update(zip(names, range(first, first + len(new))))
            self.chars += sum(map(len, names))
            at[new] = np.arange(first, first + len(new))
        self.used[at] = self.turn
        return at

    def ids(self, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at ``at[which]`` one after another, and where each word's ids end."""
        sizes = self.sizes[at].take(which)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat.take(np.repeat(self.starts[at].take(which) - (ends - sizes), sizes) + np.arange(total)), ends

    def bounded(self) -> None:
        """Lets go of words if there are too many: those used last stay. Very long words are not kept."""
        if len(self) <= MAX_UNITS and self.chars <= MAX_CHARS:
            return
        names = list(self)
        lengths = np.fromiter(map(len, names), np.int64, len(names))
        order = np.argsort(-self.used, kind="stable")
        order = order[lengths[order] <= MAX_UNIT_CHARS][:MAX_UNITS // 2]
        order = order[np.cumsum(lengths[order]) <= MAX_CHARS // 2]
        sizes = self.sizes[order]
        flat, _ = self.ids(order, np.arange(len(order)))
        self.clear()
        self.update(zip([names[i] for i in order.tolist()], range(len(order))))
        self.flat, self.starts, self.sizes, self.used = flat, np.cumsum(sizes) - sizes, sizes, self.used[order]
        self.chars = int(lengths[order].sum())


def _kinds() -> np.ndarray:
    """Kind of each byte of a lower-case Latin-1 text in UTF-8. Other than common characters are odd."""
    kinds = np.full(256, _ODD, np.uint8)
    for k, them in ((_SPACE, b" \t\r\n"), (_DIGIT, b"0123456789"), (_LETTER, bytes([*range(97, 123), 0xC3, *range(0x80, 0xC0)])),
                    (_MARK, b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')):
        kinds[list(them)] = k
    return kinds


_SPACE, _LETTER, _MARK, _DIGIT, _ODD = range(5)
_KINDS = _kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ACCENTED = np.arange(256, dtype=np.uint8)
_ACCENTED[[b for b in range(0x80, 0x9F) if b != 0x97]] += 32
#: How byte-level tokenizers write each byte; white space is left.
_LETTERS = np.array([ord(x) for x in _BYTE], "<u2")
_LETTERS[32] = 32


def _pieces(texts: list[bytes]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """What texts of Latin-1 characters are cut into, in lower case: runs of letters, of marks, and
    digits, which of them are odd, and how many lie before each text and in all. A word
    with an odd character, such as an apostrophe, is one piece."""
    data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    lead = np.flatnonzero(data == 0xC3) + 1
    data[lead] = _ACCENTED[data[lead]]
    kinds = _KINDS[data]
    signs = lead[(data[lead] == 0x97) | (data[lead] == 0xB7)]  # times and divided by
    kinds[signs] = _ODD
    odd = np.flatnonzero(kinds == _ODD)
    if len(odd):
        edge = np.flatnonzero(np.diff(kinds == _SPACE, prepend=True, append=True))
        word = np.unique(np.searchsorted(edge[0::2], odd, "right") - 1)
        steps = np.zeros(len(kinds) + 1, np.int8)
        steps[edge[0::2][word]] = 1
        steps[edge[1::2][word]] = -1
        kinds[np.cumsum(steps[:-1], dtype=np.int8).view(bool)] = _ODD
    begins = np.diff(kinds, prepend=np.uint8(_SPACE)) != 0
    begins |= kinds == _DIGIT
    kept = kinds != _SPACE
    begins &= kept
    starts = np.flatnonzero(begins)
    letters = data[kept]
    # Places among the letters kept: all before, without the white space before.
    offsets = np.append(np.cumsum(kept, dtype=np.int32)[starts] - 1, len(letters)).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters))
    return pieces, kinds[starts] == _ODD, np.searchsorted(starts, first)


def _common(body: str) -> bool:
    """Whether these are letters only, all of them below U+0250."""
    return body.isalpha() and (body.isascii() or (max(body) < "\u0250" and "\u0130" not in body))


class Encoder:
    """``encode`` returns one bytes object per text: its ids, little-endian uint32."""

    def __init__(self, path: str, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_unit = _splits_at_spaces(spec)
        self.lower = '"type": "Lowercase"' in json.dumps(spec.get("normalizer"))
        self.merges = self.tokenizer.model.tokenize
        self.marks: dict[str, bytes] = {}
        self.led = _Units(lambda u: self._unit_ids(u, " "))
        self.bare = _Units(lambda u: self._unit_ids(u, ""))
        self.direct = self.by_unit and array("I").itemsize == 4 and sys.byteorder == "little"
        if self.direct:
            probes = ["a", "Word", "word,", "élan!!", "Straße.\nÜBER", "ñandú,###", "a\nb"]
            self.fronts = {x: "" if self.lower else x.translate(_BYTES) for x in ("", " ")}
            self.direct = all([self._unit_ids(p, x) for p in probes] == self._ids([x + p for p in probes]) for x in ("", " "))
            self.led.clear()
            self.bare.clear()
        self.added = [t["content"].lower().encode() for t in spec["added_tokens"]]
        self.apart = self.direct and self.lower and _drops_white_space(spec) and not any(re.search(rb"\s|[^\0-\x7f]", a) for a in self.added)
        self.words = _Words(self._word_ids)
        if self.apart:
            # The same model, asked for pieces that are one word to the file each.
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            suffix = self.tokenizer.model.end_of_word_suffix
            self.last[[i for t, i in spec["model"]["vocab"].items() if suffix and t.endswith(suffix)]] = True
            probes = ["a Word, word", "élan!!12 Straße.\nÜBER", "ñandú,### it's (a)-b"]
            self.apart = self.encode(probes) == self._ids(probes)
            self.words = _Words(self._word_ids)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _unit_ids(self, unit: str, lead: str) -> bytes:
        """Ids of a unit. A run of common letters is one word to the tokenizer, so its ids are
        asked of the merges alone; marks behind it, and a single line feed between two such
        runs, are words of their own."""
        if self.direct:
            body = unit.rstrip(_MARKS)
            if _common(body):
                store = self.led if lead else self.bare
                return self._merged(self.fronts[lead], body) if len(body) == len(unit) else store[body] + self._mark_ids(unit[len(body):])
            if "\n" in unit:
                head, *tail = unit.split("\n")
                if all(_common(x.rstrip(_MARKS)) for x in (head, *tail)):
                    return self._mark_ids("\n").join([self.led[head] if lead else self.bare[head], *map(self.bare.__getitem__, tail)])
        return self._ids([lead + unit])[0]

    def _merged(self, front: str, body: str) -> bytes:
        """Ids of common letters."""
        if self.lower:
            body = body.lower()
        tokens = self.merges(front + (body if body.isascii() else body.translate(_BYTES)))
        return array("I", [t.id for t in tokens]).tobytes()

    def _mark_ids(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) > 1000 or len(marks) > 20:
                return self._ids([marks])[0]
            self.marks[marks] = self._ids([marks])[0]
        return self.marks[marks]

    def _word_ids(self, words: list[str], common: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each has. The first ``common`` are one word to
        the file as well and are asked of the model together: each ends with a token that ends a word."""
        found, sizes = [], []
        for lo, hi in portions(words[:common], 1 << 13):
            letters = _LETTERS[np.frombuffer(" ".join(words[lo:hi]).encode(), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.plain.encode_batch_fast([letters], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == hi - lo:
                found.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:
                common = lo
                break
        for raw in self._ids(words[common:]):
            found.append(np.frombuffer(raw, "<u4"))
            sizes.append([len(found[-1])])
        return np.concatenate(found), np.concatenate(sizes)

    def _latin(self, text: str) -> bytes | None:
        """The text in UTF-8; None if there are other than Latin-1 characters or what may be an added token."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        raw = text.encode()
        lower = raw.lower()
        return None if any(a in lower for a in self.added) else raw

    def _by_words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        pieces, odd, before = _pieces(texts)
        found = pieces.dictionary_encode()
        which = found.indices.to_numpy()
        strange = np.zeros(len(found.dictionary), bool)
        strange[which[odd]] = True
        ids, ends = self.words.ids(self.words.places(found.dictionary.to_numpy(zero_copy_only=False).tolist(), strange), which)
        self.words.bounded()
        return ids, np.diff(np.concatenate(([0], ends))[before])

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and how many each has."""
        if self.apart:
            raw = [self._latin(t) for t in texts]
            ids, sizes = self._by_words([r for r in raw if r is not None])
            if len(sizes) == len(texts):
                return ids, sizes
            own = iter(np.split(ids, np.cumsum(sizes)))
            others = iter(self._by_unit([t for t, r in zip(texts, raw) if r is None]))
            out = [np.frombuffer(next(others), "<u4") if r is None else next(own) for r in raw]
        else:
            out = [np.frombuffer(r, "<u4") for r in (self._by_unit(texts) if self.by_unit else self._ids(texts))]
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.fromiter(map(len, out), np.int64, len(out))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_unit:
            return self._ids(texts)
        if not self.apart:
            return self._by_unit(texts)
        ids, sizes = self.encode_flat(texts)
        raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes) * 4
        return [raw[e - 4 * n:e] for e, n in zip(ends.tolist(), sizes.tolist())]

    def _by_unit(self, texts: list[str]) -> list[bytes]:
        heads, tails = [], []
        for text in texts:
            if _DOUBTFUL.search(text):
                units = _BORDER.split(text)
                heads.append(units[0])
                tails.append([u[1:] for u in units[1:]])
            else:
                head, *rest = text.split(" ")
                heads.append(head)
                tails.append(rest)
        led, bare = self.led.__getitem__, self.bare.__getitem__
        out = [b"".join([bare(h), *map(led, t)]) for h, t in zip(heads, tails)]
        self.led.bounded(tails)
        self.bare.bounded([heads])
        return out


def _splits_at_spaces(spec: dict) -> bool:
    text = json.dumps([spec.get("normalizer"), spec.get("pre_tokenizer")])
    kinds = set(re.findall(r'"type": "(\w+)"', text))
    prefix = '"add_prefix_space": true' in text
    return not prefix and "ByteLevel" in kinds and kinds <= {"ByteLevel", "Sequence", "Split", "NFC", "Replace", "Lowercase"}


def _drops_white_space(spec: dict) -> bool:
    """Words of letters, single digits and runs of marks, with nothing of the white space between."""
    split = {"type": "Split", "pattern": {"Regex": _LOWER_WORDS}, "behavior": "Removed", "invert": True}
    replaced = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    normal, pre = ((spec.get(k) or {}).get(v, []) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
    return normal == [{"type": "NFC"}, replaced, {"type": "Lowercase"}] and len(pre) == 2 and pre[0] == split


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file; special tokens in a text get their own ids,
    as with the library."""
    return Encoder(path, special_as_text=False)


held_by_worker(encoder.cache_clear)


def portions(texts: list[str], limit: int = 1 << 21):
    """(from, to) of runs of texts with about ``limit`` characters at most."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
