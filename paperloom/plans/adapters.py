"""The driver tables as blocks, indexes and fixtures' rows as operator inputs. The mapping is ours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as T
from ..operators.index import build_index
from . import fixtures


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks_from(rows: DataFrame) -> DataFrame:
    """Rows with some of the block columns as blocks; the rest is derived or null.

    Needs document_id, modality, content, page_number and ord.
    """
    have = set(rows.columns)
    hierarchy = F.col("section_hierarchy") if "section_hierarchy" in have else F.array(T.section_of_page(F.col("page_number")))
    r = rows.withColumn("_h", hierarchy)
    none = lambda f: F.lit(None).cast(f.dataType)
    for f in S.BLOCKS:
        if f.name in ("table_metadata", "figure_metadata", "footnote") and f.name not in have:
            r = r.withColumn(f.name, none(f))
    name, paragraph = F.coalesce("table_metadata.table_id", "figure_metadata.figure_id", F.lit("")), F.lit(None).cast("int")
    cites = T.citations(F.col("modality"), F.col("page_number"), F.col("_h"), paragraph, name, F.col("table_metadata.table_title"), F.col("footnote.marker"), F.col("content"))
    derived = {
        "block_id": T.block_id(F.col("document_id"), F.col("page_number"), F.col("modality"), F.col("content"), F.col("ord")),
        "section_hierarchy": F.col("_h"),
        "position_in_section": F.col("ord"),
        "content_length": F.length("content"),
        "is_complete": F.lit(True),
        "extraction_confidence": F.lit(1.0),
        "extraction_warnings": F.array(),
        **cites,
    }
    return r.select(*((F.col(f.name) if f.name in r.columns else derived.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in S.BLOCKS))


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text blocks, as tables where they hold `` | ``; sources are documents."""
    d = table(spark, sf_dir, "documents")
    return blocks_from(
        d.select(
            F.col("source").alias("document_id"),
            F.when(F.contains("text", F.lit(" | ")), "TABLE").otherwise("TEXT").alias("modality"),
            F.col("text").alias("content"),
            (F.col("doc_id") % 60 + 1).cast("int").alias("page_number"),
            F.col("doc_id").alias("ord"),
        )
    )


def all_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, benchmark items as footnotes and page titles as figures."""
    b = table(spark, sf_dir, "benchmark").select(
        F.lit("benchmark").alias("document_id"), F.lit("FOOTNOTE").alias("modality"), F.col("text").alias("content"), (F.col("item_id") % 60 + 1).cast("int").alias("page_number"), F.col("item_id").alias("ord"),
        F.struct(F.concat(F.col("item_id").cast("string"), F.lit("/")).alias("marker"), F.col("item_id").cast("string").alias("normalized_marker")).alias("footnote"),
    )
    title = F.trim(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    p = table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("document_id"), F.lit("FIGURE").alias("modality"), title.alias("content"), (F.col("page_id") % 60 + 1).cast("int").alias("page_number"), F.col("page_id").alias("ord"),
        F.struct(F.concat(F.lit("Figure "), F.col("page_id").cast("string")).alias("figure_id"), F.lit("CHART").alias("figure_type"), F.lit("").alias("image_path"), F.lit("").alias("caption"), F.array().cast("array<string>").alias("panel_titles")).alias("figure_metadata"),
    )
    return document_blocks(spark, sf_dir).unionByName(blocks_from(b)).unionByName(blocks_from(p))


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one text each, turns as paragraphs."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n\n").alias("content"))
    return blocks_from(c.select(F.lit("conversations").alias("document_id"), F.lit("TEXT").alias("modality"), "content", F.lit(1).alias("page_number"), F.col("conv_id").alias("ord")))


def whole_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index with one chunk for each block of ``all_blocks``: id, order and text as they are."""
    b = all_blocks(spark, sf_dir)
    chunks = b.select(
        F.concat_ws("_", "document_id", F.col("ord").cast("string")).alias("chunk_id"), F.col("block_id").alias("parent_block_id"), "document_id", "ord", F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), "modality", "content",
        F.col("content").alias("embedding_input"), "page_number", "section_hierarchy", T.section_path(F.col("section_hierarchy")).alias("section_path"), F.lit(None).cast("string").alias("table_id"), F.col("figure_metadata.figure_id").alias("figure_id"), F.col("extraction_confidence").alias("confidence"),
    )
    return build_index(chunks)


def linkable_blocks(spark: SparkSession) -> DataFrame:
    rows = fixtures.load(spark, "linkable")
    ids = lambda c: F.col(c).isNotNull()
    return blocks_from(
        rows.select(
            "block_id", "document_id", "modality", "page_number", "ord", "content", F.array("section").alias("section_hierarchy"),
            F.when(ids("table_id"), F.struct("table_id", F.lit("").alias("table_title"), F.lit("").alias("units"), F.array().cast("array<string>").alias("footnote_refs"))).alias("table_metadata"),
            F.when(ids("figure_id"), F.struct("figure_id", F.lit("CHART").alias("figure_type"), F.lit("").alias("image_path"), F.lit("").alias("caption"), F.array().cast("array<string>").alias("panel_titles"))).alias("figure_metadata"),
            F.when(ids("marker"), F.struct("marker", T.normalize_marker(F.col("marker")).alias("normalized_marker"))).alias("footnote"),
        )
    )


def ranked_markdown(spark: SparkSession, query: str) -> tuple[DataFrame, DataFrame]:
    """One question and the markdown fixture as its ranked chunks."""
    q = spark.range(1).select(F.lit("q").alias("query_id"), F.lit(query).alias("query"))
    m = fixtures.load(spark, "markdown").select(F.lit("q").alias("query_id"), F.col("id").cast("string").alias("chunk_id"), F.col("id").alias("rank"), "content", "modality", "page_number", F.lit("Staff Report").alias("section_path"), "table_id", F.lit("").alias("figure_id"))
    return q, m


def ranked_prose(spark: SparkSession, query: str) -> tuple[DataFrame, DataFrame]:
    q = spark.range(1).select(F.lit("q").alias("query_id"), F.lit(query).alias("query"))
    m = fixtures.load(spark, "prose").select(F.lit("q").alias("query_id"), F.col("id").cast("string").alias("chunk_id"), F.col("id").alias("rank"), "content", F.lit("TEXT").alias("modality"), "page_number", F.col("section").alias("section_path"), F.lit("").alias("table_id"), F.lit("").alias("figure_id"))
    return q, m
