"""Operator 5: document quality by ordinal cumulative-link regression.

Ratings are grades 0 < 1 < ... < G. One weight vector over hashed text features is
shared by all grades, and ordered thresholds cut its score:
``P(grade <= k) = sigmoid(threshold[k] - w.x)``. Weights and thresholds are fitted
together by gradient steps on the likelihood with an L2 penalty. The model gives
the expected grade and the tail probability ``P(grade >= keep)``, by which
documents are selected.

Features are a document's words and word shapes (letters, digits and signs as
runs), hashed, as shares of its words, besides the shares of words that repeat the
word before and of lines that repeat another. So a document's score is a mean over
its words plus two terms: workers keep one number for each word form, and texts
are scored whole, where they lie.

The model is fitted on the driver from a bounded sample, ``max_rows`` labelled
rows of ``max_bytes`` of text in all, the same rows at every run (those of the
smallest hash of their id).

Edge cases: null and empty texts have no words and get the score of the bias
alone; an empty table yields an empty result; without labelled rows every weight
is 0 and all documents are kept; several ratings of one id count as their
highest, and of several texts of a rated id the least is fitted on; repeated rows
are scored alike; very long texts and words are read whole; all input columns are
kept, but for those named like a result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_ready, binary_parts, extended, give_back, labelled_texts, slices, utf8

BITS = 16
MAX_ROWS = 8000
MAX_BYTES = 96 << 20
KEEP_GRADE = 1
KEEP_TAIL = 0.5

_SHAPE = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"9"), (re.compile(rb"([^aA9])\1+"), rb"\1\1")]


def _features(word: bytes) -> tuple[int, int]:
    """Hashed word form and word shape."""
    shape = word
    for pattern, by in _SHAPE:
        shape = pattern.sub(by, shape)
    mask = (1 << BITS) - 1
    return xxhash.xxh32_intdigest(b"w" + word.lower().strip(b".,;:!?")) & mask, xxhash.xxh32_intdigest(b"s" + shape) & mask


#: Buckets of the two shares that are no word's.
_REPEATS, _LINES = 1, 2


def _shares(text: bytes, ws: list[bytes]) -> tuple[float, float]:
    """Shares of words equal to the one before, and of lines equal to an earlier one."""
    again = sum(map(bytes.__eq__, ws, ws[1:])) / max(1, len(ws))
    lines = text.split(b"\n")
    return again, 1 - len(set(lines)) / len(lines)


#: Word forms that a worker keeps, and the longest of them; others are computed each time.
KEPT, KEPT_BYTES = 250_000, 64


class _Features(dict):
    def __missing__(self, word: bytes) -> tuple[int, int]:
        out = _features(word)
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT:
                self.clear()
            self[word] = out
        return out


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and for each k the probability of a grade above k."""
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))
        return above.sum(1), above


def fit_ordinal(indptr: np.ndarray, index: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, *, steps: int = 250, rate: float = 0.15, penalty: float = 1e-6) -> OrdinalModel:
    """Weights and thresholds of greatest likelihood (Adam; thresholds as a start and positive gaps)."""
    rows = len(indptr) - 1
    w = np.zeros(1 << BITS)
    cut = np.zeros(grades - 1)
    if not rows:
        return OrdinalModel(w, np.full(grades - 1, -1.0) + np.arange(grades - 1))
    share = np.array([((grade <= k).sum() + 0.5) / (rows + 1) for k in range(grades - 1)])
    start = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(grades - 1))
    cut[0], cut[1:] = start[0], np.log(np.maximum(np.diff(start), 1e-3))
    row = np.repeat(np.arange(rows), np.diff(indptr))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(cut), np.zeros_like(cut)]
    for t in range(1, steps + 1):
        th = np.concatenate([[cut[0]], cut[0] + np.cumsum(np.exp(cut[1:]))])
        eta = np.bincount(row, weights=w[index] * value, minlength=rows)
        edge = np.concatenate([[-np.inf], th, [np.inf]])
        f = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
        hi, lo = f(edge[grade + 1] - eta), f(edge[grade] - eta)
        hi[grade == grades - 1], lo[grade == 0] = 1.0, 0.0
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_eta = (dhi - dlo) / rows
        g_th = np.array([(-(dhi * (grade == k)).sum() + (dlo * (grade == k + 1)).sum()) / rows for k in range(grades - 1)])
        g_cut = np.concatenate([[g_th.sum()], np.exp(cut[1:]) * np.cumsum(g_th[::-1])[::-1][1:]])
        g_w = np.bincount(index, weights=g_eta[row] * value, minlength=len(w)) + penalty * w
        for k, (x, g) in enumerate(((w, g_w), (cut, g_cut))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    th = np.concatenate([[cut[0]], cut[0] + np.cumsum(np.exp(cut[1:]))])
    return OrdinalModel(w, th)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Features()
    for batch in batches:
        ids, vals = [], []
        for text in utf8(batch.column(1)):
            ws = text.split()
            pairs = np.array([known[w] for w in ws], np.uint32).reshape(-1)
            i, c = np.unique(pairs, return_counts=True)
            ids.append(np.append(i, [_REPEATS, _LINES]).astype("<u4").tobytes())
            vals.append(np.append(c / max(1, len(ws)), _shares(text, ws)).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(vals, pa.binary())], names=["grade", "ids", "vals"])


def train_quality(docs: DataFrame, ratings: DataFrame, *, grades: int, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> OrdinalModel:
    """Fit on at most ``max_rows`` rated documents of ``max_bytes`` in all; ``ratings`` is (id, grade)."""
    arrow_ready(docs.sparkSession)
    rated = ratings.filter("id is not null and grade is not null").groupBy("id").agg(F.max("grade").cast("int").alias("grade"))
    sample = rated.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    scratch = Scratch(docs.sparkSession, "quality")
    texts = labelled_texts(docs, sample, scratch, id_col=id_col, text_col=text_col, max_bytes=max_bytes)
    bags = texts.select("grade", "text").mapInArrow(_bags, "grade int, ids binary, vals binary").toArrow().combine_chunks().sort_by([("grade", "ascending"), ("ids", "ascending")])
    scratch.keep()
    flat, off = binary_parts(bags["ids"].combine_chunks()) if bags.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    value, _ = binary_parts(bags["vals"].combine_chunks()) if bags.num_rows else (np.zeros(0, np.uint8), None)
    return fit_ordinal(off // 4, flat.view("<u4").astype(np.int64), value.view("<f4").astype(np.float64), bags["grade"].to_numpy().astype(np.int64), grades)


class _Scalars(dict):
    """Summed weights of a word's features."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        a, b = _features(word)
        out = float(self.weights[a] + self.weights[b])
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT:
                self.clear()
            self[word] = out
        return out


def score_quality(docs: DataFrame, model: OrdinalModel, *, keep: int = KEEP_GRADE, text_col: str = "text", prefix: str = "quality_") -> DataFrame:
    """``docs`` with the expected grade and the tail probability ``P(grade >= keep)``."""
    spark = docs.sparkSession
    docs = docs.drop(f"{prefix}grade", f"{prefix}tail")
    arrow_ready(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.thresholds))
    columns, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value
        own, scalar = OrdinalModel(weights, thresholds), _Scalars(weights)
        for batch in batches:
            texts = utf8(batch.column(at))
            score = np.zeros(len(texts))
            for a, b in slices(list(map(len, texts)), 1 << 20):
                cut = [t.split() for t in texts[a:b]]
                counts = np.array([len(c) for c in cut])
                each = np.fromiter((scalar[w] for c in cut for w in c), np.float64, int(counts.sum()))
                total = np.concatenate([[0.0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(counts)])]
                shares = np.array([_shares(t, c) for t, c in zip(texts[a:b], cut, strict=True)])
                score[a:b] = np.diff(total) / np.maximum(counts, 1) + shares @ weights[[_REPEATS, _LINES]]
            expected, above = own.grades(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected), pa.array(above[:, keep - 1])], names=[*columns, f"{prefix}grade", f"{prefix}tail"])
        scalar.clear()
        give_back()

    return docs.mapInArrow(run, extended(docs, f"{prefix}grade double, {prefix}tail double"))


def graded(labels: DataFrame) -> DataFrame:
    """(id, grade) from quality and toxicity marks: 0 junk, 1 sound but toxic, 2 sound."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0))
    return labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, 2 - toxic).alias("grade"))
