"""Operator 1: token ids as files in a byte-aligned variable-length coding.

Ids are replaced by their frequency rank over the whole corpus, so that common
ids need one byte. Four ranks share one control byte (two bits each: the number
of data bytes less one); control bytes and data bytes are kept apart. Decoding
looks the four lengths up in a 256-row numpy table; no branch for each value.

On storage a token dataset is a folder with

* ``vocab``: (rank int, id int), most frequent first, ties by id;
* ``shards``: one row for each document, in ascending ``doc_id`` order within a
  shard and over shards, with columns ``shard``, ``doc_id``, ``local_start`` (ids
  before it in its shard), ``n_tokens``, ``control`` and ``data`` (binary).

The container is Parquet, so any store that Spark can write will do, task
commits make the files whole when executors are lost, and a document can be read
alone.

Edge cases: null text counts as empty and yields only the end id; an empty table
yields an empty dataset; a null ``doc_id`` sorts first; repeated rows are kept,
each with its own range (ties in ``doc_id`` are ordered by length, then by their
ids' bytes);
columns other than ``doc_id`` and the text column are ignored; very long texts
are encoded whole. The string of a special token in a text becomes that token, as
the library does by itself.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_ready, binary_column, binary_parts, give_back, ragged_take, slices, utf8

#: Bytes of encoded pieces that one worker keeps.
CACHE_BYTES = 48 << 20
#: Bytes of text encoded at once by one worker.
SLICE_BYTES = 1 << 20

#: In texts that hold one of these, white space is not just single spaces and line feeds.
_ODD = [bytes([c]) for c in (9, 11, 12, 13, 28, 29, 30, 31)] + [b"  ", b" \n", b"\n ", b"\n\n"] + [c.encode() for c in "\x85\xa0\u1680\u205f\u3000"] + [b"\xe2\x80"]
#: Random numbers by place and byte; a piece's code is the sum of its bytes' numbers.
_PLACES = 64
_CODES = np.random.default_rng(20).integers(1 << 63, size=(_PLACES, 256), dtype=np.int64).view(np.uint64).reshape(-1) * np.uint64(2) + np.uint64(1)
#: Signs before which, after a letter, the pre-tokenizer always cuts. Letters here: A to Z, and
#: those that UTF-8 writes as 0xC3 and a second byte.
_SIGN = np.isin(np.arange(256), list(b".,;:!?%&$#*|"))
_LETTER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_LATIN = np.isin(np.arange(256), [c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)])


class Pieces:
    """Pieces of text that are known, with their ids: flat arrays, so that a piece costs a few tens of bytes.

    Codes are sorted in a large part and a small one; new codes go to the small one,
    which is merged into the large one when it has grown to a share of it. ``front``
    holds the last piece seen for each value of a code's highest bits.
    """

    FRONT_BITS = 19

    def __init__(self, dtype: np.dtype):
        self.parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int32)) for _ in range(2)]
        self.ids, self.ends = np.zeros(0, dtype), np.zeros(1, np.int64)
        self.raw, self.cuts = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.n = 0
        self.front = np.zeros(1 << self.FRONT_BITS, np.uint64), np.full(1 << self.FRONT_BITS, -1, np.int32)

    def seen(self, codes: np.ndarray) -> np.ndarray:
        """The number of each code's piece if ``front`` has it, else -1."""
        slot = (codes >> np.uint64(64 - self.FRONT_BITS)).astype(np.int32)
        return np.where(self.front[0][slot] == codes, self.front[1][slot], -1)

    def note(self, codes: np.ndarray, numbers: np.ndarray) -> None:
        slot = (codes >> np.uint64(64 - self.FRONT_BITS)).astype(np.int32)
        self.front[0][slot], self.front[1][slot] = codes, numbers

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The number of each code's piece, -1 where it is not known."""
        out = np.full(len(codes), -1, np.int32)
        for known, number in self.parts:
            if len(known):
                at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                out = np.where(known[at] == codes, number[at], out)
        return out

    @staticmethod
    def _grown(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        if used + len(more) > len(array):
            array = np.concatenate([array[:used], np.zeros(used // 4 + len(more) + 1024, array.dtype)])
        array[used : used + len(more)] = more
        return array

    def add(self, codes: np.ndarray, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, sizes: np.ndarray) -> None:
        n, k = self.n, len(codes)
        self.ids = self._grown(self.ids, int(self.ends[n]), ids)
        self.raw = self._grown(self.raw, int(self.cuts[n]), raw)
        self.ends = self._grown(self.ends, n + 1, self.ends[n] + np.cumsum(counts))
        self.cuts = self._grown(self.cuts, n + 1, self.cuts[n] + np.cumsum(sizes))
        self.n = n + k
        large, small = self.parts
        small = self._merged(small, (codes, np.arange(n, n + k, dtype=np.int32)))
        if len(small[0]) > 4096 + len(large[0]) // 8:
            large, small = self._merged(large, small), (small[0][:0], small[1][:0])
        self.parts = [large, small]

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        at = np.searchsorted(a[0], b[0])
        return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])

    def bytes(self) -> int:
        return self.ids.nbytes + self.raw.nbytes + self.ends.nbytes + self.cuts.nbytes + sum(a.nbytes + b.nbytes for a, b in self.parts)


class Encoder:
    """Ids of whole texts, through a cache of pieces.

    The pre-tokenizer of a byte-level BPE never joins text across a single space
    or line feed between visible characters, so the ids of a text without other
    white space are those of its pieces, cut before each space, around each line
    feed and between a letter and a sign. Pieces are found by a 64-bit code that
    numpy computes for all of them at once and then compared byte by byte; each new
    one is given to the library. Other texts, and those with the string of a
    special token, go to the library whole.
    """

    def __init__(self, path: str):
        # One thread: a worker has one core, and the library's own threads only add to its time.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.clear()

    def clear(self) -> None:
        self.known = Pieces(self.dtype)

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, self.dtype)

    def _library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and their numbers. They are joined by line feeds, whose id parts the result."""
        ids, sizes = [], []
        for at in range(0, len(pieces), 4000):
            part = pieces[at : at + 4000]
            got = np.array(self.tokenizer.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            cut = got == self.line[0]
            ends = np.append(np.flatnonzero(cut), len(got))
            if len(ends) != len(part):
                raise ValueError("the line feed is no token of its own in this vocabulary")
            ids.append(got[~cut])
            sizes.append(np.diff(ends, prepend=-1) - 1)
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, codes: np.ndarray, pieces: list[bytes]) -> None:
        if b"\n" in pieces:  # it comes first, so that the others can be joined by it
            k = pieces.index(b"\n")
            self.known.add(codes[k : k + 1], np.array(self.line, self.dtype), np.array([len(self.line)]), np.array([10], np.uint8), np.array([1]))
            codes, pieces = np.delete(codes, k), pieces[:k] + pieces[k + 1 :]
        if pieces:
            ids, counts = self._library([p.decode() for p in pieces])
            self.known.add(codes, ids, counts, np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]))

    def _cut(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty texts whose white space is plain, and their numbers."""
        joined = b"".join(texts)
        raw = np.frombuffer(joined, np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
        line = raw == 10
        border = line | (raw == 32)
        border[1:] |= line[:-1] | (_SIGN[raw[1:]] & _LETTER[raw[:-1]])
        border[2:] |= _SIGN[raw[2:]] & _LATIN[raw[1:-1]] & (raw[:-2] == 0xC3)
        border[begins] = True
        first = np.flatnonzero(border)
        size = np.diff(np.append(first, len(raw)))
        place = np.arange(len(raw), dtype=np.int32) - np.repeat(first.astype(np.int32), size)
        code = np.add.reduceat(_CODES.take(((place & (_PLACES - 1)) << 8) | raw), first)
        for k in np.flatnonzero(size > _PLACES).tolist():
            code[k] = xxhash.xxh3_64_intdigest(joined[first[k] : first[k] + size[k]])
        key = self.known.seen(code)
        miss = np.flatnonzero(key < 0)
        if len(miss):
            uniq, one, inverse = np.unique(code[miss], return_index=True, return_inverse=True)
            number = self.known.find(uniq)
            new = np.flatnonzero(number < 0)
            if len(new):
                at = miss[one[new]]
                spans = zip(first[at].tolist(), (first[at] + size[at]).tolist(), strict=True)
                self._learn(uniq[new], [joined[a:b] for a, b in spans])
                number = self.known.find(uniq)
            self.known.note(uniq, number)
            key[miss] = number[inverse]
        if not self._same(raw, first, size, key):
            rows = [self._whole(t) for t in texts]
            return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
        starts = self.known.ends[key]
        lengths = self.known.ends[key + 1] - starts
        ids = ragged_take(self.known.ids, starts, lengths)
        total = np.concatenate([[0], np.cumsum(lengths)])[np.append(np.searchsorted(first, begins), len(first))]
        return ids, np.diff(total)

    def _same(self, raw: np.ndarray, first: np.ndarray, size: np.ndarray, key: np.ndarray) -> bool:
        """Whether each piece equals, byte by byte, the known one that its code has found."""
        begin = self.known.cuts[key]
        if not np.array_equal(self.known.cuts[key + 1] - begin, size):
            return False
        there = np.repeat((begin - first).astype(np.int32), size)
        there += np.arange(len(raw), dtype=np.int32)
        return np.array_equal(self.known.raw.take(there), raw)

    def _all_plain(self, texts: list[bytes]) -> bool:
        """The test of ``encode`` for all texts at once; a line feed after each shows white space at its end."""
        whole = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(whole, np.uint8)
        white = (raw == 32) | (raw == 10)
        return not (white[1:] & white[:-1]).any() and not any(x in whole for x in _ODD if x not in (b"  ", b" \n", b"\n ", b"\n\n")) and not any(x in whole for x in self.special)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (UTF-8) in a row, and the number of ids of each."""
        if self.known.bytes() > CACHE_BYTES:
            self.clear()
        if texts and all(texts) and self._all_plain(texts):
            return self._cut(texts)
        plain = [bool(t) and t[-1] not in b" \n" and not any(x in t for x in (*_ODD, *self.special)) for t in texts]
        if all(plain) and texts:
            return self._cut(texts)
        rows: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(texts)
        some = [k for k, p in enumerate(plain) if p]
        if some:
            ids, counts = self._cut([texts[k] for k in some])
            for k, part in zip(some, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                rows[k] = part
        for k, p in enumerate(plain):
            if not p and texts[k]:
                rows[k] = self._whole(texts[k])
        return np.concatenate(rows) if rows else np.zeros(0, self.dtype), np.array([len(r) for r in rows], np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_ids(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned integers, of two bytes if the vocabulary allows, else four."""
    arrow_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            texts = utf8(batch.column(1))
            for a, b in slices(list(map(len, texts)), SLICE_BYTES):
                ids, counts = enc.encode(texts[a:b])
                ends = np.cumsum(counts + 1)
                out = np.full(int(ends[-1]), end_id, enc.dtype)
                keep = np.ones(len(out), bool)
                keep[ends - 1] = False
                out[keep] = ids
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts + 1), binary_column(out, np.concatenate([[0], ends]) * enc.dtype.itemsize)], names=["doc_id", "n_tokens", "ids"])
        give_back()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_counts(ids: DataFrame, dtype: str) -> DataFrame:
    """(id, n): occurrences over all documents; each batch is counted before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            raw, _ = binary_parts(batch.column(0))
            got = np.bincount(raw.view(dtype)) if len(raw) else seen[:0]
            if len(got) > len(seen):
                seen, got = got, seen
            seen[: len(got)] += got
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], names=["id", "n"])

    return ids.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


# --- the coding ------------------------------------------------------------

#: For each control byte, the number of data bytes of its four values.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3) + 1


def pack(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, their offsets, data bytes, their offsets, for rows of values.

    A row starts on a control byte of its own; lanes that its last control byte
    has to spare take no data.
    """
    values = values.astype(np.uint32)
    size = 1 + (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    groups = (counts + 3) // 4
    c_off = np.concatenate([[0], np.cumsum(groups)])
    first = np.concatenate([[0], np.cumsum(counts)])
    lane = np.arange(len(values)) + np.repeat(4 * c_off[:-1] - first[:-1], counts)
    codes = np.zeros(4 * int(c_off[-1]), np.uint8)
    codes[lane] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    data_off = np.concatenate([[0], np.cumsum(size)])
    data = np.empty(int(data_off[-1]), np.uint8)
    start = data_off[:-1]
    for k in range(int(size.max()) if len(size) else 0):
        has = slice(None) if k == 0 else size > k
        data[start[has] + k] = (values[has] >> (8 * k)).astype(np.uint8)
    return control, c_off, data, data_off[first]


def unpack(control: np.ndarray, c_off: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of all rows, one after the other."""
    first = np.concatenate([[0], np.cumsum(counts)])
    lane = np.arange(int(first[-1])) + np.repeat(4 * c_off[:-1] - first[:-1], counts)
    size = LENGTHS[control].reshape(-1)[lane]
    start = np.cumsum(size) - size
    values = data[start].astype(np.uint32)
    for k in range(1, int(size.max()) if len(size) else 0):
        has = np.flatnonzero(size > k)
        values[has] |= data[start[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


# --- files -----------------------------------------------------------------


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shards: int | None = None) -> None:
    """Encode ``docs`` and write the token dataset at ``path``.

    Texts are encoded once and staged as ids; the counts, at most one row for
    each vocabulary entry, go to the driver for ranking. The staged ids are then
    dealt by ranges of ``doc_id``, which is the only shuffle.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    ids = scratch.cut(token_ids(docs, tokenizer_path, id_col=id_col, text_col=text_col, end_id=end_id), "ids")
    dtype = encoder(tokenizer_path).dtype.str
    counted = id_counts(ids, dtype).collect()
    order = sorted(counted, key=lambda r: (-r.n, r.id))
    vocab = spark.createDataFrame([(k, r.id) for k, r in enumerate(order)], "rank int, id int")
    vocab.coalesce(1).write.parquet(f"{path}/vocab")
    to_rank = np.zeros(max((r.id for r in order), default=0) + 1, np.uint32)
    to_rank[[r.id for r in order]] = np.arange(len(order))
    shared = spark.sparkContext.broadcast(to_rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, begun = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw, off = binary_parts(batch.column(2))
            for a, b in slices(list(np.diff(off)), 8 << 20):
                counts = np.diff(off[a : b + 1]) // np.dtype(dtype).itemsize
                control, c_off, data, d_off = pack(shared.value[raw[off[a] : off[b]].view(dtype)], counts)
                local = begun + np.cumsum(counts) - counts
                begun += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, shard, np.int32)), batch.column(0).slice(a, b - a), pa.array(local), pa.array(counts), binary_column(control, c_off), binary_column(data, d_off)],
                    names=["shard", "doc_id", "local_start", "n_tokens", "control", "data"],
                )

    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens")]
    (
        ids.repartitionByRange(n, *by)
        .sortWithinPartitions(*by, "ids")
        .mapInArrow(run, "shard int, doc_id long, local_start long, n_tokens long, control binary, data binary")
        .write.option("compression", "zstd")
        .parquet(f"{path}/shards")
    )
    scratch.drop(ids)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids decoded from the files, little-endian unsigned 32-bit."""
    return _decoded(spark, path, "ids binary", lambda rows, off: [binary_column(rows, off * 4)])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""

    def digest(rows: np.ndarray, off: np.ndarray) -> list[pa.Array]:
        view = memoryview(np.ascontiguousarray(rows, "<u4")).cast("B")
        return [pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.int64())]

    return _decoded(spark, path, "ids_crc32 long", digest)


def _decoded(spark: SparkSession, path: str, extra: str, finish) -> DataFrame:
    arrow_ready(spark)
    vocab = spark.read.schema("rank int, id int").parquet(f"{path}/vocab").collect()
    to_id = np.zeros(len(vocab), np.uint32)
    for r in vocab:
        to_id[r.rank] = r.id
    shared = spark.sparkContext.broadcast(to_id)
    rows = spark.read.schema("shard int, doc_id long, local_start long, n_tokens long, control binary, data binary").parquet(f"{path}/shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column(3).to_numpy()
            control, c_off = binary_parts(batch.column(4))
            data, d_off = binary_parts(batch.column(5))
            for a, b in slices(list(np.diff(d_off)), 4 << 20):
                ranks = unpack(control[c_off[a] : c_off[b]], c_off[a : b + 1] - c_off[a], data[d_off[a] : d_off[b]], counts[a:b])
                off = np.concatenate([[0], np.cumsum(counts[a:b])])
                kept = [batch.column(k).slice(a, b - a) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*kept, *finish(shared.value[ranks], off)], names=["shard", "doc_id", "local_start", "n_tokens", extra.split()[0]])

    out = rows.mapInArrow(run, f"shard int, doc_id long, local_start long, n_tokens long, {extra}")
    # One row for each shard: the ids of the shards before it.
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    base = sums.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_base"))
    joined = out.join(base, "shard")
    return joined.select("doc_id", (F.col("_base") + F.col("local_start")).alias("start"), "n_tokens", extra.split()[0])
