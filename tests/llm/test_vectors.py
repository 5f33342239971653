"""Searches over integer vectors and resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyspark.sql.functions as F

from jobspectra.llm import negatives, resample, slices, vectorgrid
from jobspectra.llm.words import Block

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
# Columns of the input whose names the operators use for themselves.
VECTORS = "vec_id long, embedding array<double>, label int, score string, rank string, key string, part string, notes string"


def vector_rows(n=400, dim=6, seed=3, reach=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-reach, reach) for _ in range(dim)], rng.randint(0, 4)) for i in range(n)]
    hot = [0.5] * dim
    rows += [(n + i, hot, 1) for i in range(n // 2)]  # a third of all rows are copies
    rows += [(0, rows[0][1], rows[0][2]), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2]), (50, rows[9][1], 2)]  # repeated ids
    rows += [(2000, None, 1), (2050, [None, *hot[1:]], 1), (2100, [float("nan"), *hot[1:]], 1), (2150, [float("inf"), *hot[1:]], 1), (None, hot, 1),
             (2200, hot, None), (2250, hot[:3], 1), (2251, hot[:2] + [0.25], 1), (2300, [], 1), (2301, [], 2), (2350, [0.0] * dim, 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], VECTORS).repartition(5)


def usable(rows, labels):
    out = []
    for i, v, label in rows:
        if i is not None and v is not None and (label is not None or not labels) and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, label, tuple(math.floor(256.0 * x) for x in v)))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def plain_top(rows, every, k):
    rows = usable(rows, False)
    out = []
    for i, _, q in {(i, None, q) for i, _, q in rows if i % every == 0}:
        found = sorted((-dot(q, v), j) for j, _, v in rows if j != i and len(v) == len(q))[:k]
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(found, 1)]
    return sorted(out)


def plain_negatives(rows, every, positives, k):
    rows = usable(rows, True)
    out = []
    for i, label, q in {r for r in rows if r[0] % every == 0}:
        scored = [(-dot(q, v), j, other) for j, other, v in rows if j != i and len(v) == len(q)]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            near = sorted((x, j) for x, j, other in scored if other != label and 30 * -s <= 100 * -x <= 90 * -s)[:k]
            out += [(i, p, rank, j, -s, -x) for rank, (x, j) in enumerate(near, 1)]
    return sorted(out)


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_top_k(spark, monkeypatch):
    rows = vector_rows()
    monkeypatch.setattr(vectorgrid, "PIECE", 64)
    monkeypatch.setattr(slices, "meet", lambda *a: vectorgrid.meet(*a, rows_each=150, queries_each=9))
    for kept in (1, 3, 6, 40):
        assert tuples(slices.search(frame(spark, rows), F.col("vec_id") % 10 == 0, 5, slices=kept)) == plain_top(rows, 10, 5)
    assert slices.search(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert tuples(slices.search(frame(spark, rows[:3]), F.col("vec_id") % 2 == 0, 5)) == plain_top(rows[:3], 2, 5)
    huge = vector_rows(60, 3, reach=2.0 ** 20)  # needs more than 62 bits on the way
    assert tuples(slices.search(frame(spark, huge), F.col("vec_id") % 10 == 0, 5)) == plain_top(huge, 10, 5)


def test_slices_of_sums():
    rng = np.random.default_rng(2)
    for _ in range(30):
        matrix, query = rng.integers(-300, 300, (130, 5)), rng.integers(-200, 200, 5)
        block = slices.SlicedBlock(matrix, 20)
        sums = block.sums(query)
        got = np.zeros(130, np.int64)
        for weight, one in enumerate(sums):
            flags = np.zeros(192, np.int64)
            flags[block.places(one)] = 1
            got += flags[:130] << weight
        want = matrix @ query
        assert len(set(got - want)) == 1
        k = int(rng.integers(1, 20))
        allowed = rng.random(130) < 0.7
        kth = np.sort(want[allowed])[-k] if allowed.sum() >= k else -10 ** 9
        assert set(np.flatnonzero(allowed & (want >= kth))) == set(block.boundary(query, block.bitmap(allowed), k))
        coarse = slices.SlicedBlock(matrix, 3).boundary(query, block.bitmap(allowed), k)
        assert set(np.flatnonzero(allowed & (want >= kth))) <= set(coarse) <= set(np.flatnonzero(allowed))


def test_packed_products():
    rng = np.random.default_rng(5)
    for reach in (1, 200, 10 ** 5, 2 ** 30):
        matrix = rng.integers(-reach, reach + 1, (2500, 7))
        anchor = rng.integers(-reach, reach + 1, 7)
        want = [dot(map(int, row), map(int, anchor)) for row in matrix]
        assert [int(x) for x in negatives.Packed(matrix, int(np.abs(anchor).max())).scores(anchor)] == want
    wide = np.array([[2 ** 70, -2 ** 66], [-5, 3]], object)
    assert list(negatives.Packed(wide, 2 ** 80).scores(np.array([2 ** 80, -7], object))) == [2 ** 150 + 7 * 2 ** 66, -5 * 2 ** 80 - 21]


def test_hard_negatives(spark, monkeypatch):
    rows = vector_rows()
    monkeypatch.setattr(vectorgrid, "PIECE", 64)
    monkeypatch.setattr(negatives, "ROWS_EACH", 150)
    every = F.col("vec_id") % 10 == 0
    assert tuples(negatives.mine(frame(spark, rows), every)) == plain_negatives(rows, 10, 5, 10)
    assert negatives.mine(frame(spark, []), every).count() == 0
    same = [(i, v, 1) for i, v, _ in rows[:30]]
    assert negatives.mine(frame(spark, same), every).count() == 0  # no other label
    assert tuples(negatives.mine(frame(spark, rows[:40]), every, 2, 3)) == plain_negatives(rows[:40], 10, 2, 3)


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def features_of(text):
    w = words_of(text)
    return [zlib.crc32(x.encode()) % 10_000 for x in (*w, *(f"{a} {b}" for a, b in zip(w, w[1:])))]


def plain_resample(docs, target, percent=25):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features_of(text))
    for text in target:
        t.update(features_of(text))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    rows, draw = [], []
    for i, text in docs:
        f = features_of(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(words_of(text)) >= 20:
                draw.append((-score, i))
        rows.append((i, len(f), weight, score))
    return rows, sorted(draw)[:percent * len(draw) // 100]


def test_features_are_exact():
    texts = [b"Abc abc  a-b 12 x", b"", "é été É ".encode(), b"q" * 300 + b" B " + b"z" * 2000, b"a b c d e f g h " * 50]
    doc, bucket = resample.features(Block(texts, True, resample._BETWEEN))
    for i, t in enumerate(texts):
        assert sorted(bucket[doc == i].tolist()) == sorted(features_of(t.decode()))
    assert resample.crc_columns(np.array([[0, 255], [7, 1]], np.uint8)).tolist() == [zlib.crc32(b"\0\xff"), zlib.crc32(b"\7\1")]
    three = resample.features(Block([b"a b a b a b"], True, resample._BETWEEN), n=3)[1]
    assert Counter(three) == Counter(zlib.crc32(x) % 10_000 for x in [b"a", b"b"] * 3 + [b"a b", b"b a"] * 2 + [b"a b", b"a b a", b"b a b"] + [b"a b a", b"b a b"])


def test_resample(spark):
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(60)] + ["Été", "ÄB", "x" * 200]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "-- ! "), (None, "w1 " * 30), (303, "long " * 50_000), (7, docs[7][1]), (7, docs[7][1])]
    docs += [(i, "w1 w2 w3 " * 10) for i in range(400, 560)]  # a third of all rows are copies
    target = [None, "", "w1 w2 w3 w4", *(" ".join(rng.choice(pool[:20]) for _ in range(40)) for _ in range(15))]
    schema = "doc_id long, text string, score string, rank string, n_words string, eligible string, at string"
    make = lambda d: spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in d], schema).repartition(4)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(make(docs), goal).collect()
    want, drawn = plain_resample(docs, target)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(want, key=key)
    ranked = sorted((r["rank"], -r.score, r.doc_id) for r in got if r["rank"] is not None)
    assert ranked == [(n, s, i) for n, (s, i) in enumerate(drawn, 1)]
    assert resample.resample(make([]), goal).count() == 0
    alone = resample.resample(make(docs), goal.limit(0)).collect()  # an empty target
    assert sorted(((r.doc_id, r.weight) for r in alone), key=key) == sorted(((r[0], r[2]) for r in plain_resample(docs, [])[0]), key=key)
    everyone = resample.resample(make(docs), goal, percent=100).collect()
    assert sorted(r["rank"] for r in everyone if r["rank"]) == list(range(1, sum(len(words_of(t)) >= 20 and i is not None for i, t in docs) + 1))
