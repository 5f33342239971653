"""Corpus operators, queries and pipeline against brute force."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobspectra.llm import ann, neardup, ngramlm, pii, quality, toxicity
from jobspectra.llm.catalog import ENTRIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def table(spark, texts, first=0):
    rows = [(first + i, t, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, component_id string")


def plain_components(texts, k, percent=80):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def test_near_duplicates(spark):
    rng = random.Random(4)
    words = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 200))) for _ in range(12)]
    texts = [None, "", "  \n", "one", "ONE", "one two", "two one", *base]
    for b in base:
        for _ in range(6):  # chains of small changes
            w = b.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
            b = texts[-1] if rng.random() < 0.5 else b
    for k in (4, 5):
        sizes, roots = plain_components(texts, k)
        rows = neardup.near_duplicates(table(spark, texts), k=k).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], roots[r.doc_id], roots[r.doc_id] == r.doc_id)
    assert neardup.near_duplicates(table(spark, [])).count() == 0
    twice = table(spark, ["a b c d e f", "a b c d e f"])
    assert sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(twice.union(twice)).collect()) == [(0, 0), (0, 0), (1, 0), (1, 0)]


def test_near_duplicates_of_repeated_ids(spark):
    words = [f"w{i}" for i in range(200)]
    a, b = " ".join(words[:90]), " ".join(words[100:190])
    rows = [(5, a), (5, b), (6, a + " z"), (7, b + " z"), (3, "x y z u v w"), (9, "x y z u v w"), (9, a), (9, "q r s t u v"), (11, "q r s t u v"),
            (2, "lone text of its own here"), (2, None), (4, None), *[(12, a)] * 20]
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, kept string, component_id string, n long").repartition(3)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame).collect()}
    assert got == {(5, 86, 3, False), (6, 87, 3, False), (7, 87, 3, False), (3, 2, 3, True), (9, 2, 3, False), (9, 86, 3, False), (11, 2, 3, False),
                   (12, 86, 3, False), (2, 2, 2, True), (2, 0, 2, True), (4, 0, 4, True)}


def test_nearest_of_repeated_queries_and_poor_samples(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(300)]
    rows += [(100, rows[100][1]), (100, rows[100][1]), (200, [9.0, 9.0, 9.0, 9.0])]  # one query repeated, one with two vectors
    poor = [(1000 + i, v) for i, v in enumerate([None, [None] * 4, [float("nan")] * 4, [0.0] * 4, [float("inf"), 1.0, 1.0, 1.0]] * 400)]
    frame = spark.createDataFrame([(*r, "a", "b") for r in poor + rows], "vec_id long, embedding array<double>, score string, rank string").repartition(4)
    monkeypatch.setattr(ann, "SAMPLE", 40)
    index = ann.fit(frame)
    assert index.dim == 4
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(frame, F.col("vec_id") % 100 == 0, index).collect())
    want = []
    for i, v in {(i, tuple(v)) for i, v in rows if i % 100 == 0}:
        near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in rows if j != i)[:10]
        want += [(i, n, j, d) for n, (d, j) in enumerate(near, 1)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], rtol=1e-12)
    nothing = frame.where("vec_id >= 1000")
    assert ann.search(nothing, F.col("vec_id") % 100 == 0, ann.fit(nothing)).count() == 0


@pytest.mark.parametrize("percent", [50, 70, 90])
def test_near_duplicates_at_other_limits(spark, percent):
    assert neardup.band_rows(80) == 5
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(120)]
        for cut in (0, 2, 6, 12, 20, 30, 45, 60):  # shorter and shorter copies: sizes differ as much as the limit allows
            texts.append(" ".join(base[:len(base) - cut]))
    sizes, roots = plain_components(texts, 5, percent)
    rows = neardup.near_duplicates(table(spark, texts), percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == [(i, s, c) for i, (s, c) in enumerate(zip(sizes, roots))]


def test_register_estimate_is_corrected():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.8, 1.0):
        a = rng.integers(0, 2 ** 63, 600).astype(np.uint64)
        common = int(600 * 2 * share / (1 + share))
        b = np.concatenate((a[:common], rng.integers(0, 2 ** 63, 600 - common).astype(np.uint64)))
        found = neardup.estimate(neardup.registers(a)[None], neardup.registers(b)[None])[0]
        assert abs(found - share) < 0.15
    assert 0 < neardup.chance(1.0) < 1e-3


def plain_bigrams(train, texts):
    tok = lambda t: [*WORD.findall((t or "").translate(LOWER)), None]
    uni, bi = collections.Counter(), collections.Counter()
    for t in train:
        w = tok(t)
        uni.update(w)
        bi.update(zip(["<s>", *w], w))
    n, v = sum(uni.values()), len(uni)
    by = collections.Counter(bi.values())
    d = ngramlm._discounts([by[k] for k in (1, 2, 3, 4)])
    fronts = collections.Counter(b for _, b in bi)
    by = collections.Counter(fronts.values())
    low = ngramlm._discounts([by[k] for k in (1, 2, 3, 4)])
    after = collections.defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), c in bi.items():
        after[a][0] += c
        after[a][min(c, 3)] += 1
    rest = sum(low[min(c, 3) - 1] for c in fronts.values()) / len(bi) if bi else 1.0

    def p(a, w):
        one = (fronts[w] - low[min(fronts[w], 3) - 1]) / len(bi) if fronts[w] else 0.0
        one = max(one, 0.0) + rest / (v + 1)
        if a not in after:
            return one
        x, c = after[a], bi[a, w]
        return (c - d[min(c, 3) - 1] if c else 0) / x[0] + sum(d[k] * x[k + 1] for k in range(3)) / x[0] * one
    out = []
    for t in texts:
        w = tok(t)
        out.append((len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w),
                    sum(math.log10(p(a, x)) for a, x in zip(["<s>", *w], w))))
    return out, p, uni


def test_counts_beyond_32_bits_are_kept(spark):
    keys = np.array([3, 2 ** 40, 2 ** 63 + 5], np.uint64)
    counts = [np.array([1, 2 ** 32 + 5, 2 ** 50], np.int64), np.array([2 ** 33, 0, 7], np.int64)]
    back = ngramlm._unpack(ngramlm._pack(keys, *counts), 2)
    assert all((a == b).all() for a, b in zip(back, [keys, *counts]))
    assert ngramlm._qualified(spark, "/tmp/x") == ngramlm._qualified(spark, "file:/tmp/x") == "file:///tmp/x"
    assert ngramlm._qualified(spark, "file:///tmp/x") == "file:///tmp/x"


def test_bigram_model(spark):
    rng = random.Random(6)
    texts = [None, "", "a", "new words only", "the THE the", *(" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))) for _ in range(120))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(3)
    train = docs.where("doc_id % 3 <> 0")
    want, p, uni = plain_bigrams([t for i, t in enumerate(texts) if i % 3], texts)
    for r in ngramlm.score(docs, ngramlm.fit(train)).collect():
        got = (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
        assert got == pytest.approx(want[r.doc_id], rel=1e-9)
    assert sum(p("a", w) for w in uni) + p("a", "never seen") == pytest.approx(1.0)
    for r in ngramlm.score(docs, ngramlm.fit(docs.limit(0))).collect():
        assert r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0.0 and r.score == 0.0
    assert ngramlm.score(docs.limit(0), ngramlm.fit(train)).count() == 0


def test_hot_words_are_dealt_out():
    pieces = ngramlm._pieces(np.array([1, 100, 50_000]), 100_000, 64)
    assert pieces.tolist()[0] == 1 and pieces[2] > 32
    shards = ngramlm._pair_shard(np.full(5000, 9, np.uint64), np.arange(5000, dtype=np.uint64), np.full(5000, pieces[2]), 64)
    assert len(set(shards.tolist())) > 20


def test_toxicity_learns_and_stays_calm(spark):
    rng = random.Random(8)
    plain, rude = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(3000)], ["vilewort", "nastyling", "grubber"]
    texts, toxic = [], []
    for i in range(1500):
        bad = rng.random() < 0.12
        w = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(rude).upper() + rng.choice(["", ",", "s"])
        texts.append(" ".join(w))
        toxic.append(int(bad))
    docs = table(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, t if i % 4 else None) for i, t in enumerate(toxic) if i < 1000], "doc_id long, toxic int")
    model = toxicity.train(docs.where("doc_id < 1000"), labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(rows[i].predicted, toxic[i]) for i in range(1000, 1500)]
    assert sum(a == b for a, b in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert rows[1500].predicted == rows[1501].predicted == 0
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0))).count() == 0


def test_training_holds_its_features_once(spark):
    word = "translate(substr(md5(concat(id, ' ', x)), 1, 12), '0123456789', 'ghijklmnop')"
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.expr(f"array_join(transform(sequence(1, 1500), x -> {word}), ' ')").alias("text"))
    labels = spark.range(500).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    resident = lambda kind: int(re.search(rf"Vm{kind}:\s+(\d+)", open("/proc/self/status").read())[1]) / 1e3
    toxicity.train(docs.limit(20), labels)
    before = resident("RSS")
    open("/proc/self/clear_refs", "w").write("5")  # the peak counts from here
    toxicity.train(docs, labels)  # 60 MB of features
    assert resident("HWM") - before < 270 and resident("RSS") - before < 40


def brute_nearest(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if i != q][:k]
    return [(int(ids[i]), d[i]) for i in order]


def test_nearest(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((20, 8)) * 3
    x = centres[rng.integers(0, 20, 4000)] + rng.standard_normal((4000, 8))
    x[1000:1400] = x[77]  # copies
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(9000, None, 1), (9100, [0.0] * 8, 1), (9200, [1.0, None] + [0.0] * 6, 1), (9300, [float("nan")] * 8, 1), (9400, [1.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    import pyspark.sql.functions as F
    index = ann.fit(vectors)
    assert index.partitions >= 4
    found = collections.defaultdict(list)
    for r in ann.search(vectors, F.col("vec_id") % 100 == 0, index).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    ids, hits = np.arange(4000), 0
    assert sorted(found) == list(range(0, 4000, 100))
    for q, got in found.items():
        got.sort()
        want = brute_nearest(ids, x, q)
        assert [r for r, _, _ in got] == list(range(1, 11))
        assert [v for _, v, _ in got] == sorted([v for _, v, _ in got], key=lambda v: (np.sqrt(((x[v] - x[q]) ** 2).sum()), v))
        hits += len({v for _, v, _ in got} & {v for v, _ in want})
    assert hits >= 0.9 * 400
    few = vectors.where("vec_id < 3 OR vec_id = 100")
    assert ann.search(few, F.col("vec_id") == 0, ann.fit(few)).count() == 3
    assert ann.search(vectors.limit(0), F.col("vec_id") == 0, ann.fit(vectors.limit(0))).count() == 0


def test_partitions_are_balanced():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1024, 6))
    assert set(np.bincount(ann.partition(ann.neighbours(x, 8), 16)).tolist()) == {64}


@needs_data
@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query_returns_every_row(spark, name):
    tables = {"op4_main_text": "pages", "op7_nearest": "embeddings"}
    rows = ENTRIES[name][0](spark, SF).count()
    total = spark.read.parquet(f"{SF}/{tables.get(name, 'documents')}.parquet")
    if name == "op7_nearest":
        assert rows == 10 * total.where("vec_id % 100 = 0").count()
    else:
        assert rows >= total.count() and (name == "op3_packing" or rows == total.count())


@needs_data
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, SF)
    features = quality.Features(list(text(docs).values()))
    bad = np.any([r.rejects(features) for r in quality.RULES], axis=0)
    assert set(text(good)) == {d for d, b in zip(text(docs), bad) if not b} and good.columns == docs.columns
    calm = stages["toxicity"](spark, good, SF)
    model = toxicity.train(good, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = text(good)
    assert set(text(calm)) == {d for d, s in zip(kept, model.scores(list(kept.values()))) if s < 0.5} and calm.columns == docs.columns
    single = stages["near-duplicates"](spark, good, SF)
    ids = sorted(kept)
    _, roots = plain_components([kept[i] for i in ids], 5)
    assert set(text(single)) == {ids[r] for r in set(roots)} and single.columns == docs.columns
    clean = stages["personal data"](spark, single, SF)
    assert text(clean) == {i: pii.redacted(t) for i, t in text(single).items()} and clean.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    last = corpus_pipeline.run(spark, SF)
    assert last.where("length > 0").count() == last.count() > 0


def test_held_out_is_the_checksum_of_the_decimal_id(spark):
    from jobspectra.llm.catalog import held_out
    rows = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", held_out(5, 0).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
