"""From raw documents to a mixed, deduplicated, decontaminated corpus of token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import stages
from paperloom.llm.common import Scratch, table

#: (name, function): each function takes (spark, docs, sf_dir).
STAGES = [
    ("quality_classifier", stages.keep_quality),
    ("ngram_jaccard_join", stages.one_of_each_group),
    ("benchmark_decontamination", stages.without_benchmark),
    ("source_mixing", stages.mix_sources),
    ("token_files", stages.to_token_files),
]

#: SQL cannot express the first stage (a fitted model) nor the last (tokenizer and files).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written before the next reads it."""
    scratch, docs = Scratch(spark, "corpus"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
        scratch.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
