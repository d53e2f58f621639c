"""Shared plumbing: table access, shared scratch storage, Arrow batch helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes per Arrow batch handed to Python: a batch ends at whichever comes
#: first (a single longer text is a batch of its own).
ARROW_ROWS = 1000
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_ready(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Limits of Arrow batches from here on: few rows where texts are carried, more for rows of numbers.

    The session keeps them, since results are evaluated after an operator returns.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


class Scratch:
    """Parquet tables in the shared folder that the cluster names.

    ``spark.checkpoint.dir`` is read from the session; where it is unset, a folder
    under the warehouse is used on one machine (tests, a laptop), and on a cluster it
    is an error. Written tables cut lineage and survive the loss of any executor,
    unlike a local checkpoint.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        self.root = f"{root.rstrip('/')}/paperloom-{name}-{uuid.uuid4().hex}"
        self._n, self._written = 0, []

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}_{name}"

    def cut(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and return a scan of what was written."""
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        self.tidy()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self._written.append(out)
        return out

    def tidy(self) -> None:
        """Let Spark remove shuffle files that no plan refers to; it does so when the driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def keep(self, *frames: DataFrame) -> None:
        """Remove all tables but these: what an operator returns reads no others."""
        kept = {f._scratch_path for f in frames}
        self.drop(*(f for f in self._written if f._scratch_path not in kept))

    def drop(self, *frames: DataFrame) -> None:
        """Remove tables that nothing will read again."""
        gone = {f._scratch_path for f in frames}
        self._written = [f for f in self._written if f._scratch_path not in gone]
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for frame in frames:
            p = jvm.org.apache.hadoop.fs.Path(frame._scratch_path)
            p.getFileSystem(conf).delete(p, True)


def give_back() -> None:
    """Return freed memory of a worker to the system, at the end of a task that held much."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to ``most`` or hold one item."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``flat[s:s+n]`` for each start and length."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return flat[shift + np.arange(total)]


def binary_column(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow binary array over one byte buffer, no copy for each row."""
    raw = np.ascontiguousarray(flat).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without copying rows."""
    column = column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    off = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], (off - off[0]).astype(np.int64)


def labelled_texts(docs: DataFrame, sample: DataFrame, scratch: Scratch, *, id_col: str, text_col: str, max_bytes: int) -> DataFrame:
    """The rows of ``sample`` (id and others; its size is bounded) with the text of their document.

    Of several documents of one id the least text counts. Texts are taken whole, in
    the order of their id's hash, until the next would exceed ``max_bytes`` in all.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    ids = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).join(F.broadcast(sample.select("id")), "id")
    rows = scratch.cut(ids.groupBy("id").agg(F.min("text").alias("text")).join(F.broadcast(sample), "id"), "labelled")
    held = Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    fits = rows.select("id", F.sum(F.octet_length("text")).over(held).alias("held")).filter(F.col("held") <= max_bytes).select("id")
    return rows.join(F.broadcast(fits), "id")


def typed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast; so extra columns cannot clash."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()))


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with the fields of ``ddl`` after it."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])
