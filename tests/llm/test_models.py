"""Fitted operators: held-out accuracy and edge cases."""

import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import quality, queries, toxicity

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no driver tables")
EDGES = [None, "", "a", "word " * 30_000, "same text", "same text"]


def test_ordinal_thresholds_are_ordered_and_fit():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 4, 400)
    index = np.stack([100 + grade, rng.integers(200, 400, 400)], axis=1).reshape(-1)
    m = quality.fit_ordinal(np.arange(0, 801, 2), index, np.ones(800), grade, 4)
    assert (np.diff(m.thresholds) > 0).all()
    score = m.weights[index].reshape(-1, 2).sum(1)
    expected, above = m.grades(score)
    assert (np.diff(above, axis=1) <= 0).all()
    assert np.corrcoef(expected, grade)[0, 1] > 0.95


@needs_data
def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality.train_quality(docs, quality.graded(labels.filter(~held)), grades=3)
    r = quality.score_quality(docs, model).join(labels.filter(held), "doc_id").select("quality", (F.col("quality_tail") >= 0.5).alias("kept")).collect()
    good = [x.kept for x in r if x.quality == 1]
    junk = [x.kept for x in r if x.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(junk) / len(junk) < 0.15


def test_quality_edges(spark, frame):
    none = spark.createDataFrame([], "id long, grade int")
    model = quality.train_quality(frame(EDGES), none, grades=3)
    out = quality.score_quality(frame(EDGES), model)
    assert out.columns[:7] == frame(["x"]).columns
    assert all(r.quality_tail >= 0.5 for r in out.collect())
    assert quality.score_quality(frame(EDGES).limit(0), model).count() == 0


def test_quality_scores_against_brute_force(spark, frame):
    rng = np.random.default_rng(3)
    model = quality.OrdinalModel(rng.normal(0, 3, 1 << quality.BITS), np.array([-0.4, 0.9]))
    texts = [None, "", "a", "One one two\n\nOne one two", "Über 12,5 %% x@y.z A1b2 " * 9, "w" * 70_000 + " W" + "9" * 100]
    got = {r.doc_id: (r.quality_grade, r.quality_tail) for r in quality.score_quality(frame(texts).withColumn("quality_tail", F.lit(9)), model).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        ws = raw.split()
        score = sum(model.weights[f] for w in ws for f in quality._features(w)) / max(1, len(ws))
        lines = raw.split(b"\n")
        score += model.weights[quality._REPEATS] * sum(x == y for x, y in zip(ws, ws[1:], strict=False)) / max(1, len(ws)) + model.weights[quality._LINES] * (1 - len(set(lines)) / len(lines))
        above = [1 / (1 + np.exp(c - score)) for c in model.thresholds]
        assert got[k] == pytest.approx((sum(above), above[0]))


def test_quality_fit_is_a_maximum():
    rng = np.random.default_rng(4)
    grade = rng.integers(0, 3, 300)
    index = np.stack([np.where(rng.random(300) < 0.8, 10 + grade, rng.integers(10, 13, 300)), rng.integers(20, 40, 300)], axis=1).reshape(-1)
    ptr, ones = np.arange(0, 601, 2), np.ones(600)
    m = quality.fit_ordinal(ptr, index, ones, grade, 3, steps=600, rate=0.05, penalty=1e-4)

    def loss(w, cut):
        s = w[index].reshape(-1, 2).sum(1)
        at = np.concatenate([np.zeros((300, 1)), 1 / (1 + np.exp(s[:, None] - cut[None, :])), np.ones((300, 1))], axis=1)
        return -np.log(at[np.arange(300), grade + 1] - at[np.arange(300), grade]).mean() + 0.5e-4 * (w * w).sum()

    best = loss(m.weights, m.thresholds)
    for j in (10, 11, 12, 25):
        for step in (-0.3, 0.3):
            w = m.weights.copy()
            w[j] += step
            assert loss(w, m.thresholds) > best
    for step in (-0.3, 0.3):
        assert loss(m.weights, m.thresholds + np.array([0, step])) > best


def test_fitting_samples_are_bounded_and_repeatable(spark, frame):
    docs = frame(["a b"] * 30 + ["c d " * 50] * 30 + [None], ids=[*range(30), *range(30), 30])
    ratings = spark.createDataFrame([(k, k % 3) for k in range(31)], "id long, grade int")
    from paperloom.llm.common import Scratch, labelled_texts

    take = lambda most, d=docs: sorted((r.id, r.text) for r in labelled_texts(d, ratings, Scratch(spark, "t"), id_col="doc_id", text_col="text", max_bytes=most).collect())
    assert take(1 << 20) == [(k, "a b") for k in range(30)] + [(30, "")]
    assert len([t for _, t in take(30) if t]) == 10 and set(take(30)) <= set(take(60)) and take(30) == take(30, docs.repartition(5))
    one, two = (quality.train_quality(d, ratings, grades=3) for d in (docs, docs.repartition(6)))
    assert np.array_equal(one.weights, two.weights)


@needs_data
def test_toxicity_on_held_out_labels(spark):
    scored = queries.op10_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    r = scored.filter("held_out").join(labels, "doc_id").collect()
    assert all((zlib.crc32(str(x.doc_id).encode()) % 5 == 0) == x.held_out for x in r)
    pos, neg = [x.score for x in r if x.toxic == 1], [x.score for x in r if x.toxic == 0]
    better = np.mean([[a > b for b in neg] for a in pos])
    assert better > 0.9
    assert np.mean([x.predicted == x.toxic for x in r]) > 0.93


def test_toxicity_reads_long_runs_whole():
    for n in (1, 199, 200, 201, 396, 397, 1000):
        run = np.random.default_rng(n).integers(128, 256, n).astype(np.uint8).tobytes()
        cut = toxicity.pieces(b"a " + run + b" b")
        assert cut[0] == b"a" and cut[-1] == b"b" and all(len(p) <= toxicity.PIECE for p in cut)
        assert cut[1] + b"".join(p[4:] for p in cut[2:-1]) == run
    model = toxicity.ToxicityModel(np.zeros(toxicity.BUCKETS, np.float32), -1.0)
    model.bucket[toxicity.subwords([b"zwortzig"])[0]] = 200
    low, high = toxicity.score_batch([b"\xe4\xb8\xad" * 400, b"\xe4\xb8\xad" * 300 + b"zwortzig" * 5 + b"\xe4\xb8\xad" * 100], model, toxicity.WordScores())
    assert low < 0.5 < high


def test_toxicity_scores_against_brute_force():
    rng = np.random.default_rng(6)
    model = toxicity.ToxicityModel(rng.normal(0, 2, toxicity.BUCKETS).astype(np.float32), 0.3)
    vocabulary = ["a", "bc", "straße", "x9", "verylongwordindeed", "q" * 150]
    texts = [" ".join(rng.choice(vocabulary, n)).encode() for n in (0, 1, 7, 8, 9, 12, 13, 30, 31, 200)]

    def word(w):
        marked = b"<" + w + b">"
        grams, per = toxicity.subwords([w])
        assert per[0] == len(grams) == 1 + sum(max(0, len(marked) - n + 1) for n in toxicity.NGRAMS)
        return model.bucket[grams].astype(np.float64).mean()

    got = toxicity.score_batch(texts, model, toxicity.WordScores())
    for t, g in zip(texts, got, strict=True):
        values = [word(w) for w in t.split()]
        n = len(values)
        starts = [0] if n <= 8 else [*range(0, n - 8, 4), n - 8]
        best = max(np.mean(values[a : a + 8]) if values else 0.0 for a in starts)
        assert g == pytest.approx(1 / (1 + np.exp(-(best + 0.3))))


def test_toxicity_learns_subwords_and_edges(spark, frame):
    rng = np.random.default_rng(1)
    filler = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]
    docs, toxic = [], []
    for k in range(300):
        d = list(rng.choice(filler, 60))
        if k % 3 == 0:
            d[k % 50] = "zwortzig"
            d[(k + 9) % 50] = "zwortzig"
        docs.append([w.encode() for w in d])
        toxic.append(int(k % 3 == 0))
    m = toxicity.fit_toxicity(docs, np.array(toxic), epochs=(4, 12))
    clean = " ".join(filler[:60])
    s = toxicity.score_batch([clean.encode(), (clean + " zwortzig zwortzig").encode(), (clean + " zwortzigg zwortzigg").encode(), b""], m, toxicity.WordScores())
    assert s[0] < 0.5 < s[1] and s[2] > 0.5 and 0 <= s[3] <= 1
    out = toxicity.score_toxicity(frame(EDGES), m)
    got = out.orderBy("doc_id").collect()
    assert all(0 <= r.toxicity <= 1 for r in got) and got[4].toxicity == got[5].toxicity
    assert toxicity.score_toxicity(frame(EDGES).limit(0), m).count() == 0
    nothing = toxicity.train_toxicity(frame(EDGES), spark.createDataFrame([], "id long, toxic int"))
    assert toxicity.score_batch([b"a"], nothing, toxicity.WordScores())[0] < 1e-6
