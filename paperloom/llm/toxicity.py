"""Operator 10: toxicity by averaged subword embeddings and a linear softmax.

A word is the mean of the embeddings of its character n-grams (with marks for
its ends) and of itself, hashed into buckets; a passage of ``WINDOW`` words is the
mean of its words; a linear softmax maps it to clean or toxic. Embeddings and
softmax are trained jointly in numpy, first on whole documents, then on each
document's most toxic passage, which is also what a document's score is: a few
words count in a long text. N-grams of fewer than ``MIN_DOCS`` training documents
keep no embedding, so that single documents cannot be learned by heart. A
misspelling that was never seen shares n-grams with the word.

At scoring time the model is linear up to the softmax, so each bucket comes down
to one number and workers keep one number for each word. Texts are scored whole,
where they lie; passages overlap by half.

Only labels and text are used. The model is fitted on the driver from a bounded
sample: at most ``max_toxic`` toxic and ``max_clean`` clean documents of ``max_bytes``
of text in all, those of the smallest hash of their id.

Edge cases: null and empty texts are one passage without words and get the score
of the bias; an empty table yields an empty result; without labels of either
kind all scores are 0; several labels of one id count as their highest, and of
several texts of a labelled id the least is fitted on; repeated rows are scored
alike; very long texts are read whole; all input columns are kept, but for one named
like the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_ready, extended, labelled_texts, ragged_take, slices, utf8
from .textcode import mixed, words

BUCKETS = 1 << 17
DIM = 8
NGRAMS = (3, 4, 5)
WINDOW = 8
MAX_TOXIC, MAX_CLEAN = 1500, 3000
MAX_BYTES = 48 << 20
MIN_DOCS = 8
BATCH = 128
#: Longer runs without separators (Chinese text, text glued together) are cut into pieces that count as words.
PIECE = 200


def pieces(text: bytes) -> list[bytes]:
    """Words of a text; those of more than ``PIECE`` bytes as pieces that overlap by four bytes, so no n-gram is lost."""
    ws = words(text)
    if not ws or len(max(ws, key=len)) <= PIECE:
        return ws
    step = PIECE - max(NGRAMS) + 1
    return [w[a : a + PIECE] for w in ws for a in range(0, max(1, len(w) - max(NGRAMS) + 1), step)]


def subwords(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and the word itself, and their number, for each word."""
    marked = [b"<" + w + b">" for w in ws]
    size = np.array([len(m) for m in marked], np.int64)
    raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(ws)), size)
    left = ends[owner] - np.arange(len(raw))  # bytes from here to the word's end
    found, whose = [], []
    roll = np.zeros(len(raw), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        shifted = np.zeros(len(raw), np.uint64)
        shifted[: max(0, len(raw) - n + 1)] = raw[n - 1 :]
        roll = roll * np.uint64(0x100000001B3) + shifted + np.uint64(n)
        if n in NGRAMS:
            ok = left >= n
            found.append(roll[ok])
            whose.append(owner[ok])
    whole = np.zeros(len(ws), np.uint64)
    place = np.arange(len(raw)) - (ends - size)[owner]
    np.add.at(whole, owner, mixed(raw + np.uint64(256) * place.astype(np.uint64)))
    found.append(whole)
    whose.append(np.arange(len(ws)))
    codes, by = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(by, kind="stable")
    return (mixed(codes[order]) & np.uint64(BUCKETS - 1)).astype(np.int32), np.bincount(by, minlength=len(ws))


@dataclass
class ToxicityModel:
    """``bucket``: what each n-gram adds to a word's mean, toward toxic; ``bias``."""

    bucket: np.ndarray
    bias: float


def _mean_rows(table: np.ndarray, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of ``table[index]`` over consecutive runs of ``counts`` (all positive)."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.add.reduceat(table[index], starts, axis=0) / counts[:, None]


def fit_toxicity(docs: Iterable[list[bytes]], toxic: np.ndarray, *, epochs: tuple[int, int] = (4, 12), rate: float = 0.02, decay: float = 2e-3, seed: int = 7) -> ToxicityModel:
    """Joint training by gradient steps (Adam) on each document's most toxic passage."""
    if not len(toxic) or toxic.min() == toxic.max():
        return ToxicityModel(np.zeros(BUCKETS, np.float32), -50.0)
    # Texts come one by one and are kept as numbers of words.
    vocabulary: dict[bytes, int] = {}
    coded = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in d), np.int32, len(d)) for d in docs]
    parts = [subwords(list(some)) for some in batched(vocabulary, 20_000)]
    grams, per = (np.concatenate([p[k] for p in parts]) if parts else subwords([])[k] for k in range(2))
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    del vocabulary, parts
    held = np.zeros(BUCKETS, np.int64)
    for c in coded:
        u = np.unique(c)
        held[np.unique(ragged_take(grams, first[u], per[u]))] += 1
    known = held >= MIN_DOCS
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    emb[~known] = 0
    soft = rng.normal(0, 0.1, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    cut = [_passages(len(c)) for c in coded]
    state = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in (("emb", emb), ("soft", soft), ("bias", bias))}
    clock = 0
    for epoch in range(sum(epochs)):
        # Words come down to one number each, which finds every document's worst passage.
        tox = emb @ (soft[1] - soft[0])
        word_score = np.add.reduceat(tox[grams], first) / per
        order = rng.permutation(len(coded))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            picked = []
            for d in part:
                c = coded[d]
                if epoch < epochs[0]:
                    picked.append(c)
                    continue
                total = np.concatenate([[0.0], np.cumsum(word_score[c])])
                a, b = cut[d]
                k = int(np.argmax((total[b] - total[a]) / np.maximum(b - a, 1)))
                picked.append(c[a[k] : b[k]])
            counts = np.array([len(p) for p in picked])
            some = counts > 0
            flat = np.concatenate(picked) if some.any() else np.zeros(0, np.int64)
            uniq, inverse = np.unique(flat, return_inverse=True)
            g_index = ragged_take(grams, first[uniq], per[uniq])
            word_vec = _mean_rows(emb, g_index, per[uniq]) if len(uniq) else np.zeros((0, DIM), np.float32)
            vec = np.zeros((len(part), DIM), np.float32)
            if len(flat):
                vec[some] = _mean_rows(word_vec, inverse, counts[some])
            logits = vec @ soft.T + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            delta = p.copy()
            delta[np.arange(len(part)), toxic[part]] -= 1
            delta /= len(part)
            g_vec = delta @ soft
            g_soft, g_bias = delta.T @ vec, delta.sum(0)
            g_word = np.zeros((len(uniq), DIM), np.float32)
            part_of = np.repeat(g_vec / np.maximum(counts, 1)[:, None], counts, axis=0)
            for j in range(DIM):
                g_word[:, j] = np.bincount(inverse, weights=part_of[:, j], minlength=len(uniq))
            each = np.repeat(g_word / per[uniq][:, None], per[uniq], axis=0)
            g_emb = np.stack([np.bincount(g_index, weights=each[:, j], minlength=BUCKETS) for j in range(DIM)], axis=1).astype(np.float32)
            g_rows = np.flatnonzero(known & (np.bincount(g_index, minlength=BUCKETS) > 0))
            g_emb = g_emb[g_rows] + decay / BATCH * emb[g_rows]
            clock += 1
            for name, x, rows, g in (("emb", emb, g_rows, g_emb), ("soft", soft, slice(None), g_soft), ("bias", bias, slice(None), g_bias)):
                m, v = state[name]
                m[rows] += 0.1 * (g - m[rows])
                v[rows] += 0.01 * (g * g - v[rows])
                x[rows] -= rate * (m[rows] / (1 - 0.9**clock)) / (np.sqrt(v[rows] / (1 - 0.99**clock)) + 1e-8)
    return ToxicityModel((emb @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0]))


def _passages(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of passages of a text of ``n`` words, overlapping by half; the last one is full too."""
    if n <= WINDOW:
        return np.array([0]), np.array([n])
    a = np.arange(0, n - WINDOW, WINDOW // 2)
    a = np.append(a, n - WINDOW)
    return a, a + WINDOW


def train_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> ToxicityModel:
    """Fit on the whole texts of at most ``max_toxic + max_clean`` labelled documents, ``max_bytes`` in all; ``labels`` is (id, toxic)."""
    marked = labels.filter("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    pick = lambda kind, n: marked.filter(F.col("toxic") == kind).orderBy(F.xxhash64("id"), "id").limit(n)
    sample = pick(1, max_toxic).unionByName(pick(0, max_clean))
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = labelled_texts(docs, sample, scratch, id_col=id_col, text_col=text_col, max_bytes=max_bytes).select("id", "toxic", "text").toArrow().sort_by("id")
    scratch.keep()
    return fit_toxicity((pieces(b.as_py().encode()) for b in rows.column("text")), rows.column("toxic").to_numpy().astype(np.int64))


class WordScores(dict):
    """One number for each word; unknown words are computed by the batch."""

    limit = 400_000

    def learn(self, ws, bucket: np.ndarray) -> None:
        if len(self) >= self.limit:
            self.clear()
        fresh = [w for w in dict.fromkeys(ws) if w not in self]
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            grams, per = subwords(part)
            mean = np.add.reduceat(bucket[grams].astype(np.float64), np.concatenate([[0], np.cumsum(per)[:-1]])) / per
            self.update(zip(part, mean.tolist(), strict=True))


def score_batch(texts: list[bytes], model: ToxicityModel, known: WordScores) -> np.ndarray:
    out = np.zeros(len(texts))
    for a, b in slices(list(map(len, texts)), 4 << 20):
        cut = [pieces(t) for t in texts[a:b]]
        known.learn((w for c in cut for w in c), model.bucket)
        for k, c in enumerate(cut, a):
            total = np.concatenate([[0.0], np.cumsum(np.fromiter(map(known.__getitem__, c), np.float64, len(c)))])
            s, e = _passages(len(c))
            best = ((total[e] - total[s]) / np.maximum(e - s, 1)).max()
            out[k] = 1 / (1 + np.exp(-np.clip(best + model.bias, -40, 40)))
    return out


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1."""
    spark = docs.sparkSession
    docs = docs.drop(out_col)
    arrow_ready(spark)
    shared = spark.sparkContext.broadcast((model.bucket, model.bias))
    columns, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = ToxicityModel(*shared.value), WordScores()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_batch(utf8(batch.column(at)), own, known))], names=[*columns, out_col])

    return docs.mapInArrow(run, extended(docs, f"{out_col} double"))
