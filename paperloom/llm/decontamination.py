"""Operator 8: benchmark decontamination by greedy string tiling.

Words of benchmark items and documents are compared as codes. Runs of ``seed``
words that an item and a document share are the seeds. Where there are any, the
item is tiled: runs of equal words, none of them marked yet, are found by
running Karp-Rabin hashes of a search length that shrinks, and the longest are
marked first. The share of the item's words that tiles cover does not depend on
the order of the passages, so a reordered item is caught. A document that covers
``threshold`` of some item is contaminated.

Seeds are joined, in these steps:

1. Items become word codes; their distinct seeds form a table (seed, item).
2. Documents are scanned where they lie. A sieve of a fixed number of bits, made
   from all seeds of the benchmark, lets through the document's seeds that may be
   an item's, as (text, seed, place) with the seed's own words. A text is told by
   its digest, so copies of one text come down to one before anything is shuffled.
3. These join the benchmark's seeds. A text and an item stay together where the
   seeds that they share can cover enough of the item: a tile of n words holds
   seeds at n - seed + 1 places, at least one for every ``seed`` words.
4. Each such pair is tiled: tiles consist of seeds, so the text's stretches of
   shared seeds suffice, with barriers between them.

Documents meet what their digest has found; nothing grows with the benchmark on
the driver or in a worker but the sieve, which ends at 64 MB.

Edge cases: null and empty texts cover nothing; items without words match
nothing; an item of fewer than ``seed`` words must stand in the document as a
whole; repeated items and rows each count; a null item id is kept; ties between
items all count; texts of any length are read whole; an empty table yields an
empty result. Other input columns are kept, but for one named like the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_ready, give_back, utf8
from .textcode import WordHash, shingles, words

SEED = 5
THRESHOLD = 0.5
#: Bits of the sieve: at least so many, so many for each seed, and at most so many.
SIEVE_LEAST, SIEVE_EACH, SIEVE_MOST = 1 << 23, 256, 1 << 29
#: Found texts (a digest and a short list each) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000

_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def _windows(seq: list[int], marked: list[bool], n: int) -> Iterator[tuple[int, int]]:
    """(hash, start) of each unmarked run of ``n`` codes, by a rolling Karp-Rabin hash."""
    top = pow(_BASE, n - 1, _PRIME)
    h = run = 0
    for i, x in enumerate(seq):
        if marked[i]:
            h = run = 0
            continue
        if run == n:
            h = (h - seq[i - n] * top) % _PRIME
        else:
            run += 1
        h = (h * _BASE + x) % _PRIME
        if run == n:
            yield h, i - n + 1


def tiles(item: list[int], doc: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """(start in item, start in document, length) of the tiles of ``least`` codes or more.

    Negative codes in ``doc`` are barriers that match nothing.
    """
    least = max(1, min(least, len(item)))
    done_p, done_d = [False] * len(item), [x < 0 for x in doc]
    out: list[tuple[int, int, int]] = []
    n = max(least, min(len(item), 32))
    while True:
        table: dict[int, list[int]] = {}
        for h, i in _windows(doc, done_d, n):
            table.setdefault(h, []).append(i)
        matches = []
        for h, p in _windows(item, done_p, n):
            for d in table.get(h, ()):
                # Only the left end of a run starts a match.
                if p and d and item[p - 1] == doc[d - 1] and not done_p[p - 1] and not done_d[d - 1]:
                    continue
                k = 0
                while p + k < len(item) and d + k < len(doc) and item[p + k] == doc[d + k] and not done_p[p + k] and not done_d[d + k]:
                    k += 1
                if k >= n:
                    matches.append((-k, p, d))
        for k, p, d in sorted(matches):
            # What is left of a match after longer ones were marked.
            k = -k
            free = 0
            while free < k and not done_p[p + free] and not done_d[d + free]:
                free += 1
            if free >= n:
                out.append((p, d, free))
                done_p[p : p + free] = [True] * free
                done_d[d : d + free] = [True] * free
            # A match cut short is found again: its rest is unmarked at this or a smaller length.
        if n == least:
            if not matches:
                return out
        else:
            n = max(least, n // 2)


def _coded_items(items: DataFrame, scratch: Scratch) -> DataFrame:
    """(item, id, codes): a number for each row, its id and its word codes, of items with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            codes = [known.codes(words(t)) for t in utf8(batch.column(1))]
            some = pa.array([len(c) > 0 for c in codes])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), pa.array([c.astype("<u8").tobytes() for c in codes], pa.binary()).filter(some)], names=["id", "codes"])

    return scratch.cut(items.mapInArrow(run, "id long, codes binary").withColumn("item", F.monotonically_increasing_id()), "items")


def _item_seeds(items: DataFrame, seed: int) -> DataFrame:
    """(k, seed, item, n, times): the distinct seeds of each item, their length, the item's words, and at how many of its places a seed stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = np.frombuffer(raw, "<u8")
                own, times = np.unique(shingles(codes, seed), return_counts=True)
                full = lambda x, t: pa.array(np.full(len(own), x, t))
                yield pa.RecordBatch.from_arrays([full(min(seed, len(codes)), np.int32), pa.array(own.view(np.int64)), full(item, np.int64), full(len(codes), np.int32), pa.array(times.astype(np.int32))], names=["k", "seed", "item", "n", "times"])

    return items.select("item", "codes").mapInArrow(run, "k int, seed long, item long, n int, times int")


def _sieve(seeds: DataFrame) -> np.ndarray:
    """Bits of all seeds, by their lowest bits. Each batch sends the words of the sieve that it sets."""
    size = SIEVE_LEAST
    rows = seeds.count()
    while size < min(SIEVE_EACH * rows, SIEVE_MOST):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(batch.column(0).to_numpy().view(np.uint64) & np.uint64(size - 1))
            word, inverse = np.unique(place >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, inverse, np.uint64(1) << (place & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["at", "bits"])

    got = seeds.select("seed").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size >> 6, "<i8")
    out[got["at"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint8)


def _text_seeds(texts: DataFrame, sieve: np.ndarray, lengths: list[int]) -> DataFrame:
    """(key, k, seed, place, codes) of the seeds of texts (key, text) that the sieve lets through."""
    shared = texts.sparkSession.sparkContext.broadcast(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = shared.value, WordHash()
        low = np.uint64(8 * len(bits) - 1)
        for batch in batches:
            keys, k_, seeds, places, parts = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                codes = known.codes(words(text))
                for k in lengths:
                    if len(codes) < k:
                        continue
                    own = shingles(codes, k)
                    place = own & low
                    at = np.flatnonzero(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                    if len(at):
                        keys += [key] * len(at)
                        k_ += [k] * len(at)
                        seeds.append(own[at].view(np.int64))
                        places.append(at)
                        parts += [codes[a : a + k].astype("<u8").tobytes() for a in at.tolist()]
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()), pa.array(k_, pa.int32()), pa.array(np.concatenate(seeds)), pa.array(np.concatenate(places).astype(np.int64)), pa.array(parts, pa.binary())],
                    names=["key", "k", "seed", "place", "codes"],
                )
        known.clear()
        give_back()

    return texts.mapInArrow(run, "key string, k int, seed long, place long, codes binary")


def _covered(pairs: DataFrame, seed: int) -> DataFrame:
    """(key, id, coverage) of pairs (key, id, want, hits): the share of the item's words that tiles cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = []
            for raw, hits in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                want = np.frombuffer(raw, "<u8").tolist()
                stretch, end = [], -1
                for hit in hits:
                    a, own = hit["place"], np.frombuffer(hit["codes"], "<u8").tolist()
                    if a > end:
                        if stretch:
                            stretch.append(-1)
                        end = a
                    stretch += own[end - a :]
                    end = a + len(own)
                share.append(sum(n for _, _, n in tiles(want, stretch, seed)) / len(want))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, pa.float64())], names=["key", "id", "coverage"])

    return pairs.select("key", "id", "want", "hits").mapInArrow(run, "key string, id long, coverage double")


def _key(text_col: str) -> Column:
    return F.md5(F.col(f"`{text_col}`").cast("string"))


def covered_items(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """(key, hits): for the digest of each text that covers items, array<struct<item_id, coverage>>; written to shared storage."""
    spark = docs.sparkSession
    arrow_ready(spark)
    scratch = Scratch(spark, "benchmark")
    items = _coded_items(benchmark.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text")), scratch)
    seeds = scratch.cut(_item_seeds(items, seed), "seeds")
    lengths = sorted(r.k for r in seeds.select("k").distinct().collect())  # ``seed`` numbers at most
    texts = docs.select(_key(text_col).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("key is not null")
    found = scratch.cut(_text_seeds(texts, _sieve(seeds), lengths).groupBy("key", "k", "place", "seed").agg(F.first("codes").alias("codes")), "found")
    each = found.join(seeds, ["k", "seed"]).repartition("key", "item").groupBy("key", "item", "seed").agg(F.first("times").alias("times"), F.first("n").alias("n"), F.first("k").alias("k"), F.collect_list(F.struct("place", "codes")).alias("hits"))
    pairs = each.groupBy("key", "item").agg(F.sum("times").alias("places"), F.first("n").alias("n"), F.first("k").alias("k"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))
    # Covered words are threshold * n at least, and a tile of l words has l - k + 1 seeds: l / k or more.
    enough = pairs.filter(F.col("places") * F.col("k") >= F.lit(threshold) * F.col("n") - 1e-9)
    wanted = enough.join(items.select("item", "id", F.col("codes").alias("want")), "item")
    hits = _covered(wanted, seed).filter(F.col("coverage") >= threshold)
    out = scratch.cut(hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("item_id"), "coverage"))).alias("hits")), "hits")
    scratch.keep(out)
    return out


def _met(docs: DataFrame, found: DataFrame, text_col: str, how: str) -> DataFrame:
    """Rows of ``docs`` (as ``row``) joined with what their text has found."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _key(text_col).alias("key"))
    return rows.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, "key", how)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", out_col: str = "hits", **options) -> DataFrame:
    """``docs`` with ``out_col``: array<struct<item_id, coverage>> of the items that a document covers."""
    found = covered_items(docs, benchmark, text_col=text_col, **options)
    none = F.array().cast("array<struct<item_id:bigint,coverage:double>>")
    own = [F.col("row")[c].alias(c) for c in docs.columns if c != out_col]
    return _met(docs, found, text_col, "left").select(*own, F.coalesce("hits", none).alias(out_col))


def flag_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that cover a benchmark item."""
    found = covered_items(docs, benchmark, text_col=text_col, **options)
    return _met(docs, found.select("key"), text_col, "left_anti").select(*(F.col("row")[c].alias(c) for c in docs.columns))
