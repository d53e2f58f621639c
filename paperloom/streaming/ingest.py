"""Blocks as a stream: chunks and index rows, each chunk once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S
from ..operators.chunk import ChunkConfig, chunk_blocks
from ..operators.index import build_index


def stream_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks from Parquet files that arrive below ``path``."""
    return spark.readStream.schema(S.BLOCKS).parquet(path)


def stream_index(blocks: DataFrame, cfg: ChunkConfig = ChunkConfig(), window: str = "1 day") -> DataFrame:
    """Index rows of a stream of blocks; a chunk id is passed on once within ``window`` of its arrival.

    Ids are forgotten after that, so the state stays bounded; readers of the index
    keep the last of chunks that were added more than once (``store.open_index``).
    """
    arrived = build_index(chunk_blocks(blocks, cfg)).withColumn("_arrived", F.current_timestamp())
    return arrived.withWatermark("_arrived", window).dropDuplicatesWithinWatermark(["chunk_id"]).drop("_arrived")


def start(index: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return index.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
