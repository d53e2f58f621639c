"""Rule-based rerank by seven signals, and its report (K6, K7)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RerankConfig:
    # Fixed values.
    term_overlap: float = 0.10
    modality_match: float = 0.10
    modality_mismatch: float = -0.05
    exact_id: float = 0.30
    section: float = 0.05
    high_confidence: float = 0.02
    low_confidence: float = -0.05
    complete: float = 0.02
    fragment: float = -0.01
    length: float = -0.01


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), 0))


def signals(cfg: RerankConfig = RerankConfig()) -> dict[str, Column]:
    """What each signal adds; an id counts once, be it a table's or a figure's."""
    lit = lambda x: F.lit(float(x))
    q = words(F.col("query"))
    overlap = F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(F.col("content")))) / F.size(q)).otherwise(0.0)
    same_id = (F.col("q_table_id") == F.col("table_id")) | (F.col("q_figure_id") == F.col("figure_id"))
    conf, size = F.col("extraction_confidence"), F.length("content")
    return {
        "term_overlap": overlap * cfg.term_overlap,
        "modality_match": F.when(F.col("expected_modality").isNull(), lit(0)).when(F.col("modality") == F.col("expected_modality"), lit(cfg.modality_match)).otherwise(lit(cfg.modality_mismatch)),
        "id_match": F.when(same_id, lit(cfg.exact_id)).otherwise(lit(0)),
        "section_match": F.when(F.contains(F.lower("section_path"), F.lower("section_hint")), lit(cfg.section)).otherwise(lit(0)),
        "confidence": F.when(conf >= 0.95, lit(cfg.high_confidence)).when(conf < 0.5, lit(cfg.low_confidence)).otherwise(lit(0)),
        "completeness": F.when(F.col("total_chunks") == 1, lit(cfg.complete)).otherwise(lit(cfg.fragment)),
        "length": F.when((size < 100) | (size > 2000), lit(cfg.length)).otherwise(lit(0)),
    }


def rerank(candidates: DataFrame, queries: DataFrame, top_k: int | None = None, cfg: RerankConfig = RerankConfig()) -> DataFrame:
    """K6: candidates (with ``score`` and ``rank``) by the sum of score and signals.

    Adds the signals, ``final_score``, ``final_rank`` and ``rank_change`` (positive: moved up).
    """
    asked = queries.select("query_id", "query", "expected_modality", "q_table_id", "q_figure_id", "section_hint")
    parts = signals(cfg)
    out = candidates.join(asked, "query_id").select(*(F.col(c) for c in candidates.columns), *(F.round(v, 12).alias(f"s_{n}") for n, v in parts.items()))
    out = out.withColumn("final_score", F.round(F.col("score") + sum((F.col(f"s_{n}") for n in parts), F.lit(0.0)), 12))
    out = out.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final_score"), "rank")))
    out = out.withColumn("rank_change", F.col("rank") - F.col("final_rank"))
    return out if top_k is None else out.filter(F.col("final_rank") <= top_k)


def before_after(reranked: DataFrame, top_n: int = 10, movers: int = 5) -> DataFrame:
    """K7: (query_id, part, place, chunk_id, score, rank_change): best before, best after, most moved."""
    moved = reranked.withColumn("_m", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.abs("rank_change")), "final_rank")))
    part = lambda name, place, score, n: moved.filter(F.col(place) <= n).select("query_id", F.lit(name).alias("part"), F.col(place).alias("place"), "chunk_id", F.col(score).alias("score"), "rank_change")
    return part("before", "rank", "score", top_n).unionByName(part("after", "final_rank", "final_score", top_n)).unionByName(part("movers", "_m", "final_score", movers))
