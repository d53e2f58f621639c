"""Index: metadata, vectors, checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

Embedder = Callable[[list[str]], list[list[float]]]


def embed(chunks: DataFrame, embedder: Embedder | None = None, dim: int = V.DIM, text: str = "embedding_input") -> DataFrame:
    """A ``vector`` and an ``embed_error`` column.

    Without ``embedder`` the vectors come from hashes, in the JVM. With one, it is
    called on Arrow batches; a batch that fails becomes null vectors with the error.
    """
    if embedder is None:
        return chunks.withColumn("vector", V.hash_embedding(F.col(text), dim)).withColumn("embed_error", F.lit(None).cast("string"))

    @F.pandas_udf("vector array<double>, embed_error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            filled = [t if t and t.strip() else V.PLACEHOLDER for t in texts]
            try:
                rows = [list(map(float, v)) for v in embedder(filled)]
                yield pd.DataFrame({"vector": rows, "embed_error": None})
            except Exception as e:  # a failed batch must not stop the others
                yield pd.DataFrame({"vector": [None] * len(filled), "embed_error": str(e)})

    out = chunks.withColumn("_e", run(F.col(text)))
    length = V.norm(F.col("_e.vector"))
    unit = F.transform("_e.vector", lambda x: F.when(length > 0, x / length).otherwise(x))
    return out.withColumn("vector", unit).withColumn("embed_error", F.col("_e.embed_error")).drop("_e")


def build_index(chunks: DataFrame, embedder: Embedder | None = None, dim: int = V.DIM) -> DataFrame:
    """one row for each chunk that has a vector; missing ids are empty strings."""
    e = embed(chunks, embedder, dim)
    level = lambda k: F.coalesce(F.get("section_hierarchy", k), F.lit(""))
    return e.filter("embed_error is null").select(
        "chunk_id",
        "parent_block_id",
        "document_id",
        "modality",
        "page_number",
        "section_path",
        level(0).alias("section_level_0"),
        level(1).alias("section_level_1"),
        F.coalesce("table_id", F.lit("")).alias("table_id"),
        F.coalesce("figure_id", F.lit("")).alias("figure_id"),
        "chunk_index",
        "total_chunks",
        F.col("confidence").alias("extraction_confidence"),
        "ord",
        F.col("content").alias("document"),
        F.lower("content").alias("content_lc"),
        "vector",
    )


def embedding_failures(embedded: DataFrame, low: float = 0.5) -> DataFrame:
    """What failed, and what is stored in spite of a low confidence."""
    reason = F.when(F.col("embed_error").isNotNull(), F.concat(F.lit("embedding failed: "), "embed_error")).when(F.col("confidence") < low, "low extraction confidence")
    return embedded.withColumn("reason", reason).filter("reason is not null").select("chunk_id", "reason", F.substring("content", 1, 100).alias("input_preview"), F.col("confidence").alias("extraction_confidence"))


def embedding_summary(embedded: DataFrame) -> DataFrame:
    """A15."""
    failed = F.count_if(F.col("embed_error").isNotNull())
    return embedded.agg(F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) - failed).alias("successful"), failed.alias("failed"), F.count_if(F.col("confidence") < 0.5).alias("low_confidence"))


def modality_histogram(index: DataFrame) -> DataFrame:
    """A2."""
    return index.groupBy("modality").agg(F.count(F.lit(1)).alias("chunks"))


def duplicate_count(index: DataFrame, key: str = "chunk_id") -> DataFrame:
    """A3."""
    return index.agg(F.count(F.lit(1)).alias("total"), F.countDistinct(key).alias("unique_ids"), (F.count(key) - F.countDistinct(key)).alias("duplicates"))


def dimension_check(index: DataFrame, vector: str = "vector", ord_col: str = "ord", sample: int = 100) -> DataFrame:
    """A4: dimensions of all vectors, norms of the first ones."""
    dims = index.agg(F.countDistinct(F.size(vector)).alias("dims"), F.min(F.size(vector)).alias("min_dim"), F.max(F.size(vector)).alias("max_dim"))
    first = index.select(ord_col, vector).orderBy(ord_col).limit(sample).select(V.norm(F.col(vector)).alias("n"))
    norms = first.agg(F.min("n").alias("min_norm"), F.max("n").alias("max_norm"), F.avg("n").alias("avg_norm"), F.count("n").alias("sampled"))
    return dims.crossJoin(norms)  # one row each


def metadata_nulls(index: DataFrame, fields: tuple[str, ...] = ("chunk_id", "parent_block_id", "document_id", "modality", "page_number")) -> DataFrame:
    """(field, missing)."""
    counts = index.agg(*(F.count_if(F.col(f).isNull() | (F.col(f).cast("string") == "")).alias(f) for f in fields))
    return counts.unpivot([], list(fields), "field", "missing")


def section_coverage(index: DataFrame, section: str = "section_level_0") -> DataFrame:
    """A5."""
    return index.agg(F.countDistinct(F.nullif(F.col(section), F.lit(""))).alias("sections"))


def self_similarity(index: DataFrame, key: str = "chunk_id", vector: str = "vector", sample: int = 10) -> DataFrame:
    """For a fixed sample, the id and cosine of the nearest vector of all. The sample is small and broadcast."""
    queries = index.select(F.col(key).alias("query_id"), F.col(vector).alias("_q")).orderBy(F.md5(F.col("query_id").cast("string")), "query_id").limit(sample)
    scored = index.select(F.col(key).alias("id"), F.col(vector).alias("_v")).join(F.broadcast(queries)).select("query_id", "id", F.round(V.cosine(F.col("_q"), F.col("_v")), 6).alias("score"))
    best = F.max_by(F.struct("id", "score"), F.struct("score", F.col("id") == F.col("query_id")))
    return scored.groupBy("query_id").agg(best.alias("b")).select("query_id", F.col("b.id").alias("nearest_id"), F.col("b.score").alias("score"))


def cross_modality_similarity(index: DataFrame, modality: str = "modality", ord_col: str = "ord", vector: str = "vector", first: int = 5) -> DataFrame:
    """Cosines between the first few of each modality; a few rows for each modality are joined."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(modality).orderBy(ord_col))
    few = index.select(modality, ord_col, vector).withColumn("_k", place).filter(F.col("_k") <= first)
    a = few.select(F.col(modality).alias("modality_a"), F.col(ord_col).alias("ord_a"), F.col(vector).alias("_a"))
    b = few.select(F.col(modality).alias("modality_b"), F.col(ord_col).alias("ord_b"), F.col(vector).alias("_b"))
    return a.join(b, F.col("modality_a") < F.col("modality_b")).select("modality_a", "modality_b", "ord_a", "ord_b", V.cosine(F.col("_a"), F.col("_b")).alias("similarity"))


def check_index(index: DataFrame, expected_chunks: int | None = None, expected_dim: int = V.DIM) -> DataFrame:
    """V2: (check_name, passed, value) of nine checks."""
    one = lambda df, name, passed, value: df.select(F.lit(name).alias("check_name"), F.coalesce(passed, F.lit(False)).alias("passed"), value.cast("double").alias("value"))
    total = index.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("modality") == "TEXT").alias("text"))
    dims = dimension_check(index)
    norms = index.select("ord", "vector").orderBy("ord").limit(100).agg(F.max(F.abs(V.norm(F.col("vector")) - 1)).alias("off"))
    selves = self_similarity(index).agg(F.count_if(F.col("query_id") == F.col("nearest_id")).alias("right"), F.count(F.lit(1)).alias("n"))
    cross = cross_modality_similarity(index).agg(F.avg("similarity").alias("s"))
    ratio = F.col("text") / F.greatest("n", F.lit(1))
    parts = [
        one(total, "coverage", F.lit(True) if expected_chunks is None else F.col("n") == expected_chunks, F.col("n")),
        one(duplicate_count(index), "no_duplicates", F.col("duplicates") == 0, F.col("duplicates")),
        one(dims, "dimensions", (F.col("dims") == 1) & (F.col("max_dim") == expected_dim), F.col("max_dim")),
        one(norms, "vector_norms", F.col("off") < 0.1, F.col("off")),
        one(total, "modality_distribution", ratio.between(0.3, 0.98), ratio),
        one(section_coverage(index), "section_coverage", F.col("sections") >= 2, F.col("sections")),
        one(metadata_nulls(index).agg(F.sum("missing").alias("m")), "metadata_completeness", F.col("m") == 0, F.col("m")),
        one(selves, "self_similarity", (F.col("right") == F.col("n")), F.col("right")),
        one(cross, "cross_modality_distinction", F.coalesce(F.col("s"), F.lit(0.0)) < 0.8, F.coalesce(F.col("s"), F.lit(0.0))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_summary(checks: DataFrame) -> DataFrame:
    """A16."""
    return checks.agg(F.count(F.lit(1)).alias("total_checks"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.every("passed").alias("is_valid"))


def sanity_similarities(index: DataFrame, words: tuple[str, ...] = ("gdp", "growth"), unrelated: tuple[str, ...] = ("footnote", "annex")) -> DataFrame:
    """V3: a chunk about the topic, a table and an unrelated chunk, each by falling choices, and their cosines."""

    def pick(*choices) -> DataFrame:
        rank = F.lit(len(choices))
        for k, c in reversed(list(enumerate(choices))):
            rank = F.when(c, k).otherwise(rank)
        return index.agg(F.min_by("vector", F.struct(rank, "ord")).alias("v"))

    has = lambda ws: F.exists(F.array(*(F.lit(w) for w in ws)), lambda w: F.contains(F.col("content_lc"), w))
    topic = pick((F.col("modality") == "TEXT") & has(words), has(words)).withColumnRenamed("v", "topic")
    table_ = pick((F.col("modality") == "TABLE") & has(words), F.col("modality") == "TABLE").withColumnRenamed("v", "tab")
    other = pick(F.lower(F.col("modality")).isin(*unrelated), ~has(words)).withColumnRenamed("v", "other")
    row = topic.crossJoin(table_).crossJoin(other)  # one row each
    return row.select(
        V.cosine(F.col("topic"), F.col("topic")).alias("self"),
        V.cosine(F.col("topic"), F.col("tab")).alias("topic_table"),
        V.cosine(F.col("topic"), F.col("other")).alias("topic_other"),
        V.cosine(F.col("tab"), F.col("other")).alias("table_other"),
        V.health(F.col("topic"))["is_unit"].alias("is_unit"),
    )
