"""Evaluation of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(specs: DataFrame, ranked: DataFrame, answers: DataFrame) -> DataFrame:
    """One row for each question with scores, and whether it passed.

    ``specs`` is (query_id, query, expected_modality, expected_keywords, category). A
    question without an answer is a failed row, not an error (E2).
    """
    seen = ranked.groupBy("query_id").agg(F.array_sort(F.collect_set(F.lower("modality"))).alias("modalities"), F.count(F.lit(1)).alias("chunks_retrieved"))
    out = specs.join(seen, "query_id", "left").join(answers.select("query_id", "answer_text", "answer_type", "confidence", F.size("citations").alias("citation_count")), "query_id", "left")
    text = F.lower(F.coalesce("answer_text", F.lit("")))
    found = F.filter("expected_keywords", lambda k: F.contains(text, F.lower(k)))
    got = F.coalesce("modalities", F.array().cast("array<string>"))
    match = F.when(F.col("expected_modality") == "mixed", F.size(got) > 1).otherwise(F.array_contains(got, F.lower("expected_modality")))
    score = F.when(F.coalesce(F.size("expected_keywords"), F.lit(0)) <= 0, 1.0).otherwise(F.size(found) / F.size("expected_keywords"))
    return out.select(
        "query_id",
        "category",
        "expected_modality",
        match.alias("modality_match"),
        F.coalesce(F.size(found), F.lit(0)).alias("keywords_found"),
        F.round(score, 6).alias("keyword_score"),
        (match & (score >= 0.5)).alias("passed"),
        F.substring(F.coalesce("answer_text", F.lit("")), 1, 500).alias("answer_text"),
        F.coalesce("answer_type", F.lit("ERROR")).alias("answer_type"),
        F.coalesce("chunks_retrieved", F.lit(0)).alias("chunks_retrieved"),
        F.coalesce("citation_count", F.lit(0)).alias("citation_count"),
    )


def _figures() -> list:
    total, good = F.count(F.lit(1)), F.count_if("passed")
    return [
        total.alias("total"),
        good.alias("passed"),
        (total - good).alias("failed"),
        F.round(100.0 * good / total, 1).alias("pass_rate"),
        F.round(F.avg("keyword_score"), 3).alias("avg_keyword_score"),
        F.round(100.0 * F.count_if("modality_match") / total, 1).alias("modality_match_rate"),
    ]


def overall(results: DataFrame) -> DataFrame:
    """A7."""
    return results.agg(*_figures())


def by_modality(results: DataFrame) -> DataFrame:
    """In the order text, table, figure, mixed."""
    order = F.array_position(F.array(*(F.lit(m) for m in ("text", "table", "figure", "mixed"))), F.col("expected_modality"))
    return results.groupBy("expected_modality").agg(*_figures()).withColumn("place", order)


def by_category(results: DataFrame) -> DataFrame:
    """A9."""
    return results.groupBy("category").agg(*_figures())


def report(results: DataFrame) -> DataFrame:
    """A7 to A9 in one pass: grouping sets of modality and category."""
    sets = results.groupingSets([["expected_modality"], ["category"], []], "expected_modality", "category").agg(F.grouping_id().alias("gid"), *_figures())
    part = F.when(F.col("gid") == 1, "modality").when(F.col("gid") == 2, "category").otherwise("overall")
    return sets.select(part.alias("part"), F.coalesce("expected_modality", "category", F.lit("all")).alias("name"), "total", "passed", "failed", "pass_rate", "avg_keyword_score", "modality_match_rate")


def dashboard(results: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row of totals, totals by category and the modalities that were retrieved."""
    total, good = F.count(F.lit(1)), F.count_if("passed")
    each = results.groupBy(F.coalesce("category", F.lit("unknown")).alias("key")).agg(F.struct(total.alias("total"), good.alias("passed")).alias("value"))
    entries = lambda df, name: df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias(name))
    kinds = ranked.groupBy(F.col("modality").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    sums = results.agg(total.alias("total"), good.alias("passed"), (total - good).alias("failed"), F.round(100.0 * good / total, 4).alias("pass_rate"))
    return sums.crossJoin(entries(each, "categories")).crossJoin(entries(kinds, "modality_counts"))  # one row each


def assessment(results: DataFrame) -> DataFrame:
    """Points of a hundred, and how many of three modalities passed."""
    rate = F.count_if("passed") / F.count(F.lit(1))
    return results.agg(F.round(100 * (0.6 * F.avg("keyword_score") + 0.4 * rate), 2).alias("points"), F.round(F.countDistinct(F.when(F.col("passed"), F.col("expected_modality"))) / 3, 4).alias("modality_share"))
