"""Operator 4: exact n-gram Jaccard join with filters under several global orders.

A document's set is its distinct ``k``-word shingles as 64-bit codes. Documents
with equal sets form a class, told by a 64-bit code of the set; only classes are
compared. Two sets of sizes n and m reach the threshold when they share
``need(n, m)`` codes, so under any one order of all codes they share one within
the first ``n - need + 1`` (prefix) of each.

1. Codes that come very often are noted while documents are coded. Of the others a
   share is drawn by hash, a little larger than any prefix. Each class sends its drawn
   codes (one shuffle), which tells how many classes hold each of them. The first order
   is: drawn codes that one class holds, drawn codes that more hold, rarer ones first,
   then codes not drawn, then those noted. So a class's prefix starts with codes that
   can meet nothing; where these fill it, the class has no partner and sends nothing
   more. What is left of prefixes is short: texts that only share a passage hold enough
   codes of their own, however many of them share it.
2. Classes send what is left of their prefixes by code. Classes that meet under a code,
   fit in size and stand early enough in both prefixes are candidates. Codes met by up
   to ``BIG`` classes give all their pairs. Codes met by more give each class a leader
   among those of like size, the one with the fewest rarer codes before (of near copies,
   the one with the fewest changes), and their rows are kept for step 5. A class keeps
   the ``LEADERS`` leaders that it meets under the most codes.
3. A candidate pair stays if it is one under every order: signatures, which hold a
   class's prefixes under the other orders, meet, and the pair must share a code of
   each. Parity bits in the signature bound from below by how many codes the sets
   differ. Only what passes all of this has its sets brought together, by the partner
   with many candidates salted, and its common codes counted.
4. Links give components.
5. Under codes met by many, classes of different components remain to be compared:
   for each such code, those outside its largest component with all of like size.
   Rows whose place is too late for even the smallest partner go first; sizes and
   places are conditions of the join, so pairs that fail them are not made. Pairs
   pass the same filters and the same count, then components are joined. So no link
   between different components is lost, and groups of many near copies never expand
   into all their pairs.

Classes are told apart by 64 bits; a second code of 64 bits is compared within each
class, and where it differs all codes are made anew from another seed.

Edge cases: documents without words or text have an empty set, link with nothing
and are their own component; a null id is kept, and a component of null ids only
has a null ``component_id``; repeated rows fall into one class; of ties in a
component the smallest id names it; very long texts are used whole, as one set;
an empty table yields an empty result; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_ready, give_back, slices, utf8
from .graph import components
from .textcode import mixed, shingle_sets

BIG = 4
LEADERS = 2
#: Codes that one worker counts together; a code seen ``OFTEN`` times there is noted.
CHUNK_CODES = 6_000_000
OFTEN = 4
#: Places of the table of frequent codes that all workers get; its size does not depend on the input.
TABLE_BITS = 22
#: How much larger than a prefix the share of drawn codes is; rows of one code that are held before its count is given as "many".
DRAWN, MANY = 1.3, 100_000
#: A leader's partners are split over salts of about so many.
SALT_ROWS = 32
#: Salts of the orders: the first makes candidates, the others filter them.
_ORDERS = (np.uint64(0), np.uint64(0xA5A5A5A5DEADBEEF), np.uint64(0x0123456789ABCDEF))


class Threshold:
    """Jaccard similarity of ``num / den`` in whole numbers."""

    def __init__(self, num: int = 85, den: int = 100):
        self.num, self.den = num, den

    def need(self, n, m):
        """Common codes that sets of n and m codes need."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def prefix(self, n):
        return n - -(-self.num * n // self.den) + 1

    def fits(self, n, m):
        return (self.den * np.minimum(n, m) >= self.num * np.maximum(n, m)) if isinstance(n, np.ndarray) else (self.den * min(n, m) >= self.num * max(n, m))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """The shingle set of each text of a batch."""
    texts = utf8(batch.column(1))
    for a, b in slices(list(map(len, texts)), 1 << 20):
        yield from shingle_sets(texts[a:b], k)


def set_code(codes: np.ndarray, seed: int = 0) -> int:
    """A code of a sorted set, as a signed 64-bit number."""
    return int((mixed(codes + np.uint64(len(codes) + (seed << 40))).sum(dtype=np.uint64) ^ np.uint64(len(codes))).astype(np.int64))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _members(texts: DataFrame, k: int, seed: int) -> DataFrame:
    """One row for each document (kind 0: doc_id, class, n, check code), and for each code often met in a chunk (kind 1: place in the table, -, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), np.zeros(0, np.uint64), 0

        def often() -> pa.RecordBatch:
            """Counts of the codes held, which are sorted where they stand."""
            codes = held[:size]
            codes.sort()
            last = np.append(codes[1:] != codes[:-1], True) if size else np.zeros(0, bool)
            if size >= OFTEN:
                last[OFTEN - 1 :] &= codes[OFTEN - 1 :] == codes[: 1 - OFTEN]
            last[: OFTEN - 1] = False
            end = np.flatnonzero(last)
            n = end + 1 - np.searchsorted(codes, codes[end])
            place = (mixed(codes[end]) & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
            zero = pa.array(np.zeros(len(n), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), np.int32)), pa.array(place), zero, pa.array(n.astype(np.int64)), zero], names=["kind", "a", "b", "n", "check"])

        for batch in batches:
            code, n, check = [], [], []
            for s in _sets(batch, k):
                n.append(len(s))
                code.append(set_code(s, seed) if len(s) else None)
                check.append(set_code(s, ~seed & 0xFFFF))
                if len(s) and code[-1] not in seen:
                    seen.add(code[-1])
                    if size + len(s) > CHUNK_CODES and size:
                        yield often()
                        size = 0
                    if size + len(s) > len(held):
                        held = np.concatenate([held[:size], np.zeros(max(len(s), min(size, max(0, CHUNK_CODES - size))), np.uint64)])
                    held[size : size + len(s)] = s
                    size += len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column(0), pa.array(code, pa.int64()), pa.array(n, pa.int64()), pa.array(check, pa.int64())], names=["kind", "a", "b", "n", "check"])
        yield often()
        del held
        give_back()

    return texts.mapInArrow(run, "kind int, a long, b long, n long, check long")


class _Prefixes:
    """Prefixes of sets under the orders."""

    def __init__(self, table: np.ndarray, th: Threshold):
        self.table, self.th = table, th

    def under(self, s: np.ndarray, order: int) -> np.ndarray:
        """The prefix under an order: rare codes first, then by mixed code."""
        level = self.table[mixed(s) & np.uint64((1 << TABLE_BITS) - 1)].astype(np.uint64)
        rank = (level << np.uint64(58)) | (mixed(s ^ _ORDERS[order]) >> np.uint64(6))
        p = self.th.prefix(len(s))
        some = np.argpartition(rank, p - 1)[:p] if p < len(s) else np.arange(len(s))
        return s[some[np.lexsort((s[some], rank[some]))]]

    def signature(self, s: np.ndarray) -> bytes:
        """Size, then the highest bits of each code of the prefixes under the other orders, sorted, then parity bits.

        A parity bit tells whether an odd number of the set's codes fall on its place.
        """
        size = max(128, 1 << (2 * len(s) - 1).bit_length())
        parity = np.bincount((mixed(s ^ _ORDERS[1]) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
        width = _width(self.th.prefix(len(s)))
        short = [np.sort(self.under(s, order) >> np.uint64(64 - 8 * width)).astype(f"<u{width}").tobytes() for order in range(1, len(_ORDERS))]
        return b"".join([len(s).to_bytes(4, "little"), *short, np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()])


def _width(prefix: int) -> int:
    """Bytes of a code in a signature: two tell short prefixes apart well enough."""
    return 2 if prefix <= 128 else 4


_LOW31 = (1 << 31) - 1


def _drawn_rows(texts: DataFrame, table, th: Threshold, k: int, seed: int) -> DataFrame:
    """(code, class, np) by classes once for each partition: n above 32 bits, below them a mark and a number.

    Without the mark the code is drawn, and the number is that of the class's drawn
    codes. With it the code is one of those after them that the prefix still reaches,
    and the number is its place.
    """
    share = min(1.0, DRAWN * (1 - th.num / th.den))
    below = np.uint64(int(share * (1 << 32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, levels = set(), table.value
        for batch in batches:
            parts: list[tuple[np.ndarray, int, np.ndarray]] = []
            for s in _sets(batch, k):
                if not len(s) or (c := set_code(s, seed)) in seen:
                    continue
                seen.add(c)
                x, n = mixed(s), len(s)
                level = levels[x & np.uint64((1 << TABLE_BITS) - 1)]
                drawn = (level == 0) & (x >> np.uint64(32) < below)
                own, p = s[drawn], th.prefix(n)
                low = np.full(len(own), len(own), np.int64)
                if len(own) < p:
                    rest, r = s[~drawn], (level.astype(np.uint64) << np.uint64(58) | x >> np.uint64(6))[~drawn]
                    m = p - len(own)
                    some = np.argpartition(r, m - 1)[:m] if m < len(r) else np.arange(len(r))
                    some = some[np.lexsort((rest[some], r[some]))]
                    own = np.concatenate([own, rest[some]])
                    low = np.concatenate([low, (1 << 31) + len(low) + np.arange(len(some))])
                parts.append((own, c, (n << 32) | low))
            if parts:
                size = np.array([len(o) for o, _, _ in parts])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([o for o, _, _ in parts]).view(np.int64)), pa.array(np.repeat(np.array([c for _, c, _ in parts], np.int64), size)), pa.array(np.concatenate([x for _, _, x in parts]))],
                    names=["code", "cls", "np"],
                )

    return texts.mapInArrow(run, "code long, cls long, np long")


def _shared_rows(rows: DataFrame) -> DataFrame:
    """The rows of codes that two classes or more hold, from rows sorted by code, np, class, with the level of the count; each class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, going = [np.zeros(0, np.int64)] * 3, False

        def give(code, cls, nps, many: int, given: bool = False) -> Iterator[pa.RecordBatch]:
            """Whole runs, or a stretch of one that is known to be long, of which the first row may have been given already."""
            keep = np.ones(len(code), bool)
            keep[1:] = (code[1:] != code[:-1]) | (cls[1:] != cls[:-1])
            keep[:1] = not given
            code, cls, nps = code[keep], cls[keep], nps[keep]
            begin = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
            size = np.diff(np.append(begin, len(code)))
            each = np.repeat(np.full(len(size), many) if many else size, size)
            some = np.flatnonzero(each > 1)
            level = np.ceil(np.log2(each[some])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(code[some]), pa.array(cls[some]), pa.array(nps[some]), pa.array(level)], names=["code", "cls", "np", "level"])

        for parts in _gathered(batches, MANY):
            code, cls, nps = (np.concatenate([r, *(b.column(k).to_numpy() for b in parts)]) for k, r in enumerate(rest))
            last = int(np.flatnonzero(code != code[-1])[-1]) + 1 if code[0] != code[-1] else 0
            if last:
                cut = int(np.flatnonzero(code != code[0])[0]) if going else 0
                if cut:
                    yield from give(code[:cut], cls[:cut], nps[:cut], 2 * MANY, True)
                if cut < last:
                    yield from give(code[cut:last], cls[cut:last], nps[cut:last], 0)
                going = False
            rest = [code[last:], cls[last:], nps[last:]]
            if len(rest[0]) > MANY:
                yield from give(*rest, 2 * MANY, going)
                rest, going = [x[-1:] for x in rest], True
        if len(rest[0]):
            yield from give(*rest, 2 * MANY if going else 0, going)

    return rows.mapInArrow(run, "code long, cls long, np long, level int")


def _prefix_rows(shared: DataFrame, th: Threshold) -> DataFrame:
    """(code, class, np) of the rows that stand in their class's prefix under the first order, with their place in np.

    A class's drawn codes that it alone holds come first: their number is that of its
    drawn codes without those that are here.
    """
    n, low = F.shiftright("np", 32), F.col("np").bitwiseAND(_LOW31)
    forced = F.col("np").bitwiseAND(1 << 31) != 0
    alone = low - F.count(F.when(~forced, 1)).over(Window.partitionBy("cls"))
    at = F.row_number().over(Window.partitionBy("cls").orderBy(forced, "level", "code")) - 1
    prefix = n - F.ceil(F.lit(th.num) * n / F.lit(th.den)) + 1
    placed = shared.select("code", "cls", n.alias("n"), F.when(forced, low).otherwise(alone + at).alias("place"))
    return placed.filter(F.col("place") < prefix).select("code", "cls", (F.shiftleft("n", 32) + F.col("place")).alias("np"))


def _early(th: Threshold, n, i, m, j):
    """Whether sets that first meet at places i and j can share enough."""
    need = th.need(n, m)
    return th.fits(n, m) & (1 + np.minimum(n - i, m - j) - 1 >= need)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches put together until they hold so many rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield held
            held, n = [], 0
    if held:
        yield held


def _meetings(rows: DataFrame, th: Threshold) -> DataFrame:
    """Candidates (kind 0: a, b), rows of codes met by many (kind 1: code, class, np), and a class, its leader and under how many codes (kind 2), from rows sorted by code, np, class.

    Streams: what is held is one batch and, of a code that goes on, its last stretch.
    """

    def handle(code, cls, nps, whole: bool):
        """Rows of complete runs, or a stretch of a long run."""
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != code[:-1]) | (cls[1:] != cls[:-1])
        code, cls, nps = code[keep], cls[keep], nps[keep]
        n, i = nps >> 32, nps & 0xFFFFFFFF
        a, b = [], []
        begin = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(code)))
        for m in np.unique(size[size > 1]).tolist():
            at = begin[size == m]
            if whole and m <= BIG:
                x, y = np.triu_indices(m, 1)
                step = max(1, 2_000_000 // len(x))
                for q in range(0, len(at), step):
                    l, r = (at[q : q + step, None] + x).ravel(), (at[q : q + step, None] + y).ravel()
                    ok = _early(th, n[l], i[l], n[r], i[r])
                    a.append(cls[l[ok]])
                    b.append(cls[r[ok]])
        out = []
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            z = np.zeros(len(pairs), np.int64)
            out.append((0, pairs[:, 0], pairs[:, 1], z))
        run = np.repeat(np.arange(len(size)), size)
        g = np.flatnonzero(size[run] > (BIG if whole else 1)) if len(code) else run
        if len(g):
            out.append((1, code[g], cls[g], nps[g]))
            band = np.floor(np.log(n[g]) / np.log(1.08)).astype(np.int64)
            order = g[np.lexsort((mixed(cls[g].view(np.uint64)), i[g], band, run[g]))]
            level = np.floor(np.log(n[order]) / np.log(1.08)).astype(np.int64)
            new = np.append(True, (run[order][1:] != run[order][:-1]) | (level[1:] != level[:-1]))
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            heads = order[new]
            near = run[heads][1:] == run[heads][:-1]
            l, r = np.concatenate([order, heads[:-1][near]]), np.concatenate([lead, heads[1:][near]])
            ok = (l != r) & th.fits(n[l], n[r])
            stars, times = np.unique(np.stack([cls[l[ok]], cls[r[ok]]], axis=1), axis=0, return_counts=True)
            out.append((2, stars[:, 0], stars[:, 1], times))
        return [pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y), pa.array(z)], names=["kind", "a", "b", "c"]) for kind, x, y, z in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        going = False  # the code at hand has given a stretch already
        for parts in _gathered(batches, 100_000):
            code, cls, nps = (np.concatenate([r, *(b.column(k).to_numpy() for b in parts)]) for k, r in enumerate(rest))
            last = int(np.flatnonzero(code != code[-1])[-1]) + 1 if code[0] != code[-1] else 0
            if last:
                if going:
                    # The rest of a run whose first stretches are out already.
                    cut = int(np.flatnonzero(code != code[0])[0])
                    yield from handle(code[:cut], cls[:cut], nps[:cut], False)
                    yield from handle(code[cut:last], cls[cut:last], nps[cut:last], True)
                else:
                    yield from handle(code[:last], cls[:last], nps[:last], True)
                going = False
            rest = [code[last:], cls[last:], nps[last:]]
            if len(rest[0]) > 100_000:
                yield from handle(*rest, False)
                rest, going = [x[-1:] for x in rest], True
        if len(rest[0]):
            yield from handle(*rest, not going)

    return rows.mapInArrow(run, "kind int, a long, b long, c long")


def _kept_sets(texts: DataFrame, wanted: np.ndarray, table, th: Threshold, k: int, seed: int) -> DataFrame:
    """(cls, signature, codes) of classes that the Bloom filter holds; a class may come once for each partition."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bits, pre = set(), shared.value, _Prefixes(table.value, th)
        for batch in batches:
            cls, signature, whole = [], [], []
            sets = [s for s in _sets(batch, k) if len(s)]
            codes = np.array([set_code(s, seed) for s in sets], np.int64)
            for s, c, in_it in zip(sets, codes.tolist(), _in_bloom(bits, codes.view(np.uint64)).tolist(), strict=True):
                if in_it and c not in seen:
                    seen.add(c)
                    cls.append(c)
                    signature.append(pre.signature(s))
                    whole.append(s.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(signature, pa.binary()), pa.array(whole, pa.binary())], names=["cls", "signature", "codes"])

    return texts.mapInArrow(run, "cls long, signature binary, codes binary")


def _bloom_places(c: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three places for each class, by bits of its mixed code; ``size`` is a power of two."""
    x = mixed(c)
    low = np.uint64(size - 1)
    return x & low, (x >> np.uint64(20)) & low, mixed(x + np.uint64(1)) & low


def _in_bloom(bits: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each class."""
    out = np.ones(len(c), bool)
    for p in _bloom_places(c, 8 * len(bits)):
        out &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def _bloom(pairs: DataFrame) -> np.ndarray:
    """Bits of a filter of the classes in ``pairs``, sized by their number up to 64 MB.

    Each partition sends the words that its classes set; what reaches the driver is at
    most the filter itself.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    size = 1 << 16
    rows = ends.count()
    while size < min(8 * rows, 1 << 29):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(0).to_numpy().view(np.uint64)
            places = np.unique(np.concatenate(_bloom_places(c, size)))
            word, inverse = np.unique(places >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, inverse, np.uint64(1) << (places & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["at", "bits"])

    got = ends.mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size >> 6, "<i8")
    out[got["at"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint8)


def _checked(pairs: DataFrame, payloads: DataFrame, test, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) for which ``test(payload of a, payload of b)`` holds.

    Payloads meet the pairs of their class, go on to the partner's class, and are
    tested there: two shuffles, each streaming over sorted rows. A partner with many
    pairs gets a copy of its payload for each salt.
    """
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    salted = pairs.join(many, "b")
    salt = F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")
    asks = salted.select(F.col("a").alias("cls"), F.lit(1).alias("kind"), F.col("b").alias("other"), salt.alias("salt"), F.lit(None).cast("binary").alias("payload"))
    leads = many.select(F.col("b").alias("cls"), F.lit(2).alias("kind"), F.lit(0).cast("long").alias("other"), F.col("salts").alias("salt"), F.lit(None).cast("binary").alias("payload"))
    haves = payloads.select("cls", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("other"), F.lit(0).alias("salt"), "payload")
    arrow_ready(pairs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, payload = None, None
        for batch in batches:
            out = []
            for cls, kind, other, salt_, p in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if kind == 0:
                    own, payload = cls, p
                elif cls == own:
                    if kind == 1:
                        out.append((other, salt_, 1, cls, payload))
                    else:
                        out += [(cls, q, 0, 0, payload) for q in range(salt_)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["cls", "salt", "kind", "other", "payload"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, payload = None, None
        for batch in batches:
            a, b = [], []
            for cls, salt_, kind, other, p in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if kind == 0:
                    own, payload = (cls, salt_), p
                elif (cls, salt_) == own and test(p, payload):
                    a.append(other)
                    b.append(cls)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = haves.unionByName(asks).unionByName(leads).repartition(n, "cls").sortWithinPartitions("cls", "kind").mapInArrow(send, "cls long, salt int, kind int, other long, payload binary")
    second = first.repartition(n, "cls", "salt").sortWithinPartitions("cls", "salt", "kind").mapInArrow(meet, "a long, b long")
    return scratch.cut(second, name)


class _Near:
    """Whether signatures allow a link: the pair is a candidate under every order, and parities differ at few places.

    Sets whose parities differ at d places differ by d codes at least.
    """

    def __init__(self, th: Threshold):
        self.th = th

    def __call__(self, a: bytes, b: bytes) -> bool:
        n, m = int.from_bytes(a[:4], "little"), int.from_bytes(b[:4], "little")
        if not self.th.fits(n, m):
            return False
        p, q = self.th.prefix(n), self.th.prefix(m)
        u, v = _width(p), _width(q)
        for k in range(len(_ORDERS) - 1):
            x, y = np.frombuffer(a, f"<u{u}", p, 4 + u * p * k), np.frombuffer(b, f"<u{v}", q, 4 + v * q * k)
            if u != v:
                x, y = (z if w == 2 else z >> np.uint32(16) for z, w in ((x, u), (y, v)))
            if not (y[np.minimum(np.searchsorted(y, x), q - 1)] == x).any():
                return False
        a, b = a[4 + u * p * (len(_ORDERS) - 1) :], b[4 + v * q * (len(_ORDERS) - 1) :]
        if len(a) < len(b):
            a, b = b, a
        x, y, size = int.from_bytes(a, "little"), int.from_bytes(b, "little"), len(a)
        while size > len(b):  # fold the longer parities onto the shorter
            size //= 2
            x = (x & ((1 << 8 * size) - 1)) ^ (x >> 8 * size)
        return (x ^ y).bit_count() <= n + m - 2 * self.th.need(n, m)


class _Verify:
    """Whether two sets share enough codes."""

    def __init__(self, th: Threshold):
        self.th = th

    def __call__(self, a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
        return _common(x, y) >= self.th.need(len(x), len(y))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many codes two arrays of distinct codes share."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _only(kept: DataFrame, column: str, wanted: np.ndarray) -> DataFrame:
    """One column, as payload, of the classes that the Bloom filter holds."""
    shared = kept.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in_bloom(shared.value, batch.column(0).to_numpy().view(np.uint64))))

    return kept.select("cls", F.col(column).alias("payload")).mapInArrow(run, "cls long, payload binary")


def _links(pairs: DataFrame, kept: DataFrame, th: Threshold, scratch: Scratch) -> DataFrame:
    """Verified links among candidate pairs (a, b): the other orders first, by signatures, then the sets of what is left."""
    pairs = pairs.select("a", "b")
    if pairs.isEmpty():
        return pairs
    near = _checked(pairs, _only(kept, "signature", _bloom(pairs)), _Near(th), scratch, "near")
    if near.isEmpty():
        return near
    return _checked(near, _only(kept, "codes", _bloom(near)), _Verify(th), scratch, "links")


def _toward(pairs: DataFrame) -> DataFrame:
    """(lo, hi, a, b): the class with many partners, ``lead`` where there is one, is ``b``, which is salted."""
    b = F.coalesce("lead", "hi")
    return pairs.select("lo", "hi", F.when(b == F.col("hi"), F.col("lo")).otherwise(F.col("hi")).alias("a"), b.alias("b"))


def _between(many: DataFrame, labels: DataFrame, th: Threshold, scratch: Scratch) -> DataFrame:
    """Candidate pairs (lo, hi, lead) of classes in different components, from rows (code, cls, n, i) of codes met by many; ``lead`` is outside the code's largest component."""
    placed = scratch.cut(many.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")), "many")
    sizes = placed.groupBy("code", "component").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"))
    main = scratch.cut(sizes.groupBy("code").agg(F.max_by("component", F.struct("rows", "component")).alias("main"), F.min("least").alias("least"), F.count(F.lit(1)).alias("parts")).filter("parts > 1"), "main")
    need = lambda n, m: F.ceil(F.lit(th.num) * (n + m) / F.lit(th.num + th.den))
    n, i = F.col("n"), F.col("i")
    smallest = F.greatest(F.ceil(F.lit(th.num) * n / F.lit(th.den)), F.col("least"))
    band = F.floor(F.log(n) / F.log(F.lit(th.den / th.num) + 1e-9))  # sizes that fit stand in one band or the next
    early = scratch.cut(placed.join(main.select("code", "main", "least"), "code").filter(n - i >= need(n, smallest)).select("code", "cls", "n", "i", "component", (F.col("component") != F.col("main")).alias("outside"), band.alias("band")), "mixed")
    other = early.filter("outside").select(F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band2"), *(F.col(c).alias(f"{c}2") for c in ("code", "cls", "n", "i", "component")))
    fits = (th.den * F.least("n", "n2") >= th.num * F.greatest("n", "n2")) & (F.least(n - i, F.col("n2") - F.col("i2")) >= need(n, F.col("n2")))
    once = ~F.col("outside") | (F.col("cls") < F.col("cls2"))
    met = early.join(other, (F.col("code") == F.col("code2")) & (F.col("band") == F.col("band2")) & (F.col("component") != F.col("component2")) & fits & once)
    return met.groupBy(F.least("cls", "cls2").alias("lo"), F.greatest("cls", "cls2").alias("hi")).agg(F.max("cls2").alias("lead"))


def similarity_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 4, threshold: tuple[int, int] = (85, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each input row."""
    spark = docs.sparkSession
    scratch, th = Scratch(spark, "jaccard"), Threshold(*threshold)
    texts = _texts(docs, id_col, text_col)
    arrow_ready(spark)
    seed = 0
    while True:
        scanned = scratch.cut(_members(texts, k, seed), "members")
        members = scanned.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("cls"), F.col("n").alias("n_shingles"), "check")
        classes = members.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"), (F.min("check") != F.max("check")).alias("two"))
        if classes.filter("two").isEmpty():
            break
        seed += 1
        scratch.drop(scanned)
    often = scanned.filter("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").cast("int").alias("a"), F.least(F.lit(60), F.ceil(F.log2("n"))).cast("byte").alias("level")).toArrow()
    table = np.zeros(1 << TABLE_BITS, np.uint8)
    table[often["a"].to_numpy()] = often["level"].to_numpy()
    shared = spark.sparkContext.broadcast(table)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_code = lambda rows: rows.repartition(n, "code").sortWithinPartitions("code", "np", "cls")
    held = scratch.cut(_shared_rows(by_code(_drawn_rows(texts, shared, th, k, seed))), "held")
    met = scratch.cut(_meetings(by_code(_prefix_rows(held, th)), th), "met")
    scratch.drop(held)
    led = met.filter("kind = 2").groupBy("a", "b").agg(F.sum("c").alias("times"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("times"), "b"))
    led = led.withColumn("place", place).filter(F.col("place") <= LEADERS).select("a", "b", F.col("b").alias("lead"))
    both = met.filter("kind = 0").select("a", "b", F.lit(None).cast("long").alias("lead")).unionByName(led)
    pairs = scratch.cut(_toward(both.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.max("lead").alias("lead"))), "pairs")
    wanted = _bloom(pairs.select("a", "b").unionByName(met.filter("kind = 1").select("b", F.col("b").alias("a")).distinct()))
    kept = scratch.cut(_kept_sets(texts, wanted, shared, th, k, seed), "kept")
    links = _links(pairs, kept, th, scratch).select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = components(links, scratch)

    many = met.filter("kind = 1").select(F.col("a").alias("code"), F.col("b").alias("cls"), F.shiftright("c", 32).alias("n"), F.col("c").bitwiseAND((1 << 32) - 1).alias("i"))
    if not many.isEmpty():
        rest = scratch.cut(_toward(_between(many, labels, th, scratch).join(pairs, ["lo", "hi"], "left_anti")), "rest")
        more = _links(rest, kept, th, scratch).select(F.col("a").alias("u"), F.col("b").alias("v"))
        if not more.isEmpty():
            labels = components(links.unionByName(more), scratch)

    joined = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    first = scratch.cut(joined.groupBy("component").agg(F.min("least").alias("component_id")), "first")
    scratch.keep(scanned, labels, first)
    of_class = joined.select("cls", "component").join(first, "component").select("cls", "component_id")
    return members.join(of_class, "cls", "left").select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
