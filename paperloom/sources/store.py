"""Tables on storage: blocks, relationships, manifests, the index and logs (S11 to S19, E3, Q a and b)."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S

#: Columns that the exported JSON of blocks and relationships holds.
BLOCK_EXPORT = ("block_id", "document_id", "modality", "content", "page_number", "section_hierarchy", "citation_short", "citation_full", "content_length", "extraction_confidence", "extraction_warnings", "bounding_box")
EDGE_EXPORT = ("relationship_id", "source_block_id", "target_block_id", "relationship_type", "reference_text")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder on storage that all executors share: below ``spark.checkpoint.dir``; on one machine where that is unset, below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/paperloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to shared storage and read from there: what several arms read is computed once, and each reads its own columns."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Parquet by modality, so that readers of one kind skip the files of others."""
    blocks.write.mode("append").partitionBy("modality").parquet(path)


def export_blocks(blocks: DataFrame, path: str) -> None:
    """JSON lines for other tools."""
    blocks.select(*BLOCK_EXPORT).write.mode("overwrite").json(path)


def export_relationships(edges: DataFrame, path: str) -> None:
    edges.select(*EDGE_EXPORT).write.mode("overwrite").json(path)


def read_blocks_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Blocks from JSON; what the export leaves out is null."""
    got = spark.read.schema(S.BLOCKS).option("multiLine", multi_line).json(path)
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "block_id"))
    return got.withColumn("ord", F.coalesce("ord", order.cast("long")))


def write_manifest(manifest: DataFrame, path: str, status: str = "success", warnings: int = 20) -> None:
    """One JSON row for each document, with its first warnings."""
    cut = manifest.withColumn("warnings", F.slice("warnings", 1, warnings)) if "warnings" in manifest.columns else manifest
    cut.withColumn("status", F.lit(status)).withColumn("ingestion_timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("overwrite").json(path)


def add_to_index(index: DataFrame, path: str, collection: str) -> None:
    """Appended; a chunk that is added again is the same row to readers."""
    index.withColumn("collection", F.lit(collection)).withColumn("added", F.current_timestamp()).write.mode("append").partitionBy("collection").parquet(path)


def replace_index(index: DataFrame, path: str, collection: str) -> None:
    """One collection written anew; others stay."""
    rows = index.withColumn("collection", F.lit(collection)).withColumn("added", F.current_timestamp())
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def open_index(spark: SparkSession, path: str, collection: str, latest_only: bool = True) -> DataFrame:
    """A collection; of chunks added more than once the last is kept."""
    rows = spark.read.parquet(path).filter(F.col("collection") == collection)
    if latest_only:
        last = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("added")))
        rows = rows.withColumn("_k", last).filter("_k = 1").drop("_k")
    return rows.drop("collection", "added")


def index_size(spark: SparkSession, path: str, collection: str) -> int:
    """S16."""
    return open_index(spark, path, collection).count()


def read_index_json(spark: SparkSession, path: str) -> DataFrame:
    """An index kept as one JSON document of embeddings with metadata."""
    meta = "chunk_id:string,parent_block_id:string,document_id:string,modality:string,page_number:int,section_path:string,section_level_0:string,section_level_1:string,table_id:string,figure_id:string,chunk_index:int,total_chunks:int,extraction_confidence:double"
    raw = spark.read.schema(f"embeddings array<struct<id:string,vector:array<double>,metadata:struct<{meta}>,document:string>>").option("multiLine", True).json(path)
    e = raw.select(F.posexplode("embeddings").alias("ord", "e"))
    return e.select("e.metadata.*", F.col("ord").cast("long").alias("ord"), F.col("e.document").alias("document"), F.lower("e.document").alias("content_lc"), F.col("e.vector").alias("vector")).withColumn("chunk_id", F.coalesce("chunk_id", F.lit("")))


def write_failures(failures: DataFrame, path: str) -> None:
    """S18."""
    failures.write.mode("append").json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Questions of an evaluation, from a JSON array."""
    raw = spark.read.schema("id string, query string, expected_modality string, expected_keywords array<string>, category string").option("multiLine", True).json(path)
    return raw.withColumnRenamed("id", "query_id")


def write_results(results: DataFrame, path: str, run: str) -> None:
    """Results of one run below ``run=...``."""
    results.write.mode("overwrite").json(f"{path}/run={run}")


def latest_results(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the file that was written last."""
    rows = spark.read.json(path).withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.file_modification_time")})
    last = rows.agg(F.max_by(F.regexp_extract("_file", "(.*)/", 1), F.struct("_at", "_file")).alias("_last"))
    return rows.join(F.broadcast(last), F.regexp_extract("_file", "(.*)/", 1) == F.col("_last")).drop("_file", "_at", "_last")


def session_collection(base: str, session: str) -> str:
    """The name of a session's own collection."""
    return f"{base}_{''.join(c if c.isalnum() else '_' for c in session.lower())}"


def register_views(frames: dict[str, DataFrame]) -> None:
    """Blocks, chunks, index and relationships for SQL."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
