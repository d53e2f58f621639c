"""Validation of blocks and the ingestion manifest (V1, A1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import lexicons as L


def block_rules() -> list[Column]:
    """Structs of field, message and severity; null where a rule holds."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    rule = lambda bad, field, message, severity="error": F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"), F.lit(severity).alias("severity")))
    warn = lambda bad, field, message: rule(bad, field, message, "warning")
    m, box = F.col("modality"), F.col("bounding_box")
    text = F.coalesce("content", F.lit(""))
    in_x = (box["x0"] >= 0) & (box["x0"] <= box["x1"]) & (box["x1"] <= 1)
    in_y = (box["y0"] >= 0) & (box["y0"] <= box["y1"]) & (box["y1"] <= 1)
    return [
        rule(empty("block_id"), "block_id", "required field is empty"),
        rule(empty("document_id"), "document_id", "required field is empty"),
        rule(empty("modality"), "modality", "required field is empty"),
        rule(~empty("modality") & ~m.isin(*L.MODALITIES), "modality", "invalid modality"),
        rule(F.col("page_number").isNull(), "page_number", "required field is missing"),
        rule(F.col("page_number") < 1, "page_number", "must be 1 or more"),
        rule((m == "TEXT") & (text == ""), "content", "text blocks need content"),
        warn(~F.col("extraction_confidence").between(0, 1), "extraction_confidence", "must be from 0 to 1"),
        warn((text != "") & (F.col("content_length") != F.length(text)), "content_length", "differs from the content's length"),
        rule(F.coalesce(F.size("section_hierarchy"), F.lit(0)) <= 0, "section_hierarchy", "must not be empty"),
        warn(box.isNotNull() & ~in_x, "bounding_box.x", "invalid x coordinates"),
        warn(box.isNotNull() & ~in_y, "bounding_box.y", "invalid y coordinates"),
        warn((m == "TEXT") & F.col("text_metadata").isNull(), "text_metadata", "text blocks should have text metadata"),
        warn((m == "TABLE") & F.col("table_metadata").isNull(), "table_metadata", "table blocks should have table metadata"),
        warn((m == "FIGURE") & F.col("figure_metadata").isNull(), "figure_metadata", "figure blocks should have figure metadata"),
        warn((m == "FIGURE") & F.col("figure_metadata").isNotNull() & (F.coalesce("figure_metadata.image_path", F.lit("")) == ""), "figure_metadata.image_path", "figure blocks should have an image"),
        warn((m == "FOOTNOTE") & (F.coalesce("footnote.marker", F.lit("")) == ""), "footnote.marker", "footnote blocks should have a marker"),
        warn(empty("citation_short"), "citation_short", "citations should be filled"),
    ]


def with_issues(blocks: DataFrame) -> DataFrame:
    """Blocks with ``issues`` and ``is_valid`` (no errors)."""
    out = blocks.withColumn("issues", F.array_compact(F.array(*block_rules())))
    return out.withColumn("is_valid", ~F.exists("issues", lambda i: i["severity"] == "error"))


def block_issues(blocks: DataFrame) -> DataFrame:
    """V1: one row for each issue."""
    return with_issues(blocks).select(F.coalesce(F.nullif(F.col("block_id"), F.lit("")), F.lit("<no_id>")).alias("block_id"), F.inline("issues"))


def require_valid(blocks: DataFrame) -> DataFrame:
    """V1 strict: the query fails at the first invalid block."""
    checked = with_issues(blocks)
    message = F.concat(F.lit("invalid block "), F.coalesce("block_id", F.lit("<no_id>")))
    return checked.filter(F.when(F.col("is_valid"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).select(*blocks.columns)


def manifest(blocks: DataFrame, relationships: DataFrame | None = None, low: float = 0.8) -> DataFrame:
    """A1: counts and confidence by document."""
    counts = [F.count_if(F.col("modality") == m).alias(f"{m.lower()}_count") for m in L.MODALITIES]
    out = blocks.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("total_block_count"),
        *counts,
        F.coalesce(F.avg("extraction_confidence"), F.lit(1.0)).alias("average_confidence"),
        F.count_if(F.col("extraction_confidence") < low).alias("low_confidence_count"),
        F.countDistinct("page_number").alias("pages_with_blocks"),
        F.slice(F.flatten(F.collect_list(F.slice(F.coalesce("extraction_warnings", F.array().cast("array<string>")), 1, 20))), 1, 20).alias("warnings"),
    )
    if relationships is None:
        return out
    edges = relationships.join(blocks.select(F.col("block_id").alias("source_block_id"), "document_id"), "source_block_id").groupBy("document_id").agg(F.count(F.lit(1)).alias("relationship_count"))
    return out.join(edges, "document_id", "left").withColumn("relationship_count", F.coalesce("relationship_count", F.lit(0)))


def valid_boxes(df: DataFrame, column: str = "bounding_box") -> DataFrame:
    return df.filter(F.col(column).isNull() | G.is_valid(F.col(column)))
