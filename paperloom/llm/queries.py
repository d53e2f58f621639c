"""The thin ``opN_*`` queries: each applies one operator to a whole driver table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, typed


def _tokenizer(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_digests, write_tokens

    path = Scratch(spark, "op1").path("tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, _tokenizer())
    return read_digests(spark, path)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find_personal_data, joined

    rows = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda k, kind: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *(count(k, kind) for k, kind in enumerate(KINDS)), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import similarity_classes

    return similarity_classes(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import KEEP_TAIL, graded, score_quality, train_quality

    docs = typed(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    model = train_quality(docs, graded(table(spark, sf_dir, "labels")), grades=3)
    scored = score_quality(docs, model)
    return scored.select("doc_id", F.col("quality_grade").alias("expected_grade"), F.col("quality_tail").alias("tail_probability"), (F.col("quality_tail") >= KEEP_TAIL).alias("kept"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import joined, scan_secrets

    rows = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import systematic_mix, word_count

    docs = typed(table(spark, sf_dir, "documents"), doc_id="long", source="string", text="string")
    sized = Scratch(spark, "op7").cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 16).alias("tie")), "sizes")
    mixed = systematic_mix(sized, F.col("size"), tie=F.col("tie"))
    return mixed.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("size")).alias("taken"), F.col("mix_copies").alias("copies"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import benchmark_hits

    docs = typed(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    rows = benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    best = F.array_max(F.transform("hits", lambda x: F.struct(x["coverage"].alias("c"), (-x["item_id"]).alias("i"))))
    return rows.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("long").alias("n_items"),
        (-best["i"]).alias("item_id"),
        F.coalesce(best["c"], F.lit(0.0)).alias("coverage"),
        F.array_sort(F.transform("hits", lambda x: x["item_id"])).alias("item_ids"),
    )


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity, train_toxicity

    docs = typed(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = typed(table(spark, sf_dir, "labels"), doc_id="long", toxic="int").filter(~held_out).select(F.col("doc_id").alias("id"), "toxic")
    scored = score_toxicity(docs, train_toxicity(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_license_scan": op2_license_scan,
    "op3_personal_data": op3_personal_data,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_secret_scan": op6_secret_scan,
    "op7_source_mixing": op7_source_mixing,
    "op8_decontamination": op8_decontamination,
    "op9_near_vectors": op9_near_vectors,
    "op10_toxicity": op10_toxicity,
}
