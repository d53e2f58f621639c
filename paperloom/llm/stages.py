"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of ``docs``, whatever others stand beside those
that a stage reads (``doc_id``, ``text``, ``source``); columns named like something
inside a stage stay as they are. Texts of any length are used whole. An empty table
gives an empty result at every stage. What a stage does with nulls, ties and
repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .decontamination import flag_contaminated
from .jaccard import similarity_classes
from .mixing import mixed_documents
from .quality import KEEP_TAIL, graded, score_quality, train_quality
from .queries import _tokenizer
from .token_files import read_digests, write_tokens


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of a sound grade reaches ``KEEP_TAIL``.

    Null and empty texts have the score of the model's bias, and stay or go with it;
    a null id only means that the row is no training row; repeated rows are judged
    alike; a tie with ``KEEP_TAIL`` stays. Without any label all documents stay.
    """
    model = train_quality(docs, graded(table(spark, sf_dir, "labels")), grades=3)
    return score_quality(docs, model, prefix="_q_").filter(F.col("_q_tail") >= KEEP_TAIL).select(*(F.col(f"`{c}`") for c in docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: five words, similarity 0.8 or more.

    Rows without an id stay: they cannot be told apart by one. Of rows equal in id
    and text one stays. Null and empty texts are no copies of each other: all stay.
    """
    classes = similarity_classes(docs, k=5, threshold=(80, 100))
    kept = classes.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id is null"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item.

    Null and empty texts cover nothing and stay, as do rows without an id; equal texts
    go together; a document that covers exactly the share asked for goes. Without a
    benchmark all documents stay.
    """
    return flag_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, twice at most.

    Null and empty texts have no words: they count nothing toward a target and are
    taken at their source's rate like the others. A null source is a source of its own.
    Ties in size stand by id, null first, then by digest; rows that are equal in all
    columns share their copies.
    """
    return mixed_documents(docs)


def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read from the token files written here.

    In the order of ids, null first, ties by length and ids. Null and empty texts are
    just the end id; each copy of a repeated row has a place of its own.
    """
    path = Scratch(spark, "pipeline").path("tokens")
    write_tokens(docs, path, _tokenizer())
    return read_digests(spark, path)
