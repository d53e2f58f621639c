"""Operator 7: mix sources to target weights by systematic sampling.

Each source gets a target number of words: a share by weight of ``share`` times
all words, but ``most`` times its own words at the highest, the excess going to
the others by weight. Within a source every document has the same expected
number of copies, ``rate = target / source_size``; documents stand in a fixed
order, their expected copies are summed from the first on, one random offset is
added, and a document is emitted once for each whole number that its stretch of
the running sum crosses. Standing in order of size keeps the words taken near
the target.

The running sum needs no single task for a source: a document's rank is the rank
in its bucket (source, size class, slot of a digest) plus the number of documents
in the buckets before it. A class holds sizes that differ by a sixteenth at most;
there are 256 slots at every size of the table, so the order, and with it the mix,
of given documents is the same whatever else the table holds in other sources.
Sums over buckets go by source and class, then by slot. Only sizes and digests pass
the windows; ``mixed_documents`` joins the texts on at the end.

Edge cases: null text has size 0; a null source is a source of its own, last in
order; a source without words has target 0 and its documents are not taken; an
empty table stays empty; very long texts only count by their words; documents of
one size stand by id (null first), then by digest, and rows that tie in all of
these are equal, so it does not matter which of them is taken; null ids spread over
slots by their digest. All input columns are kept, but for those named like a
result: ``prefix`` chooses these names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, target, rate) from (source, size) rows.

    With ``cap = most * size``, targets are ``least(cap, level * weight)``. The
    level at which they add up is the largest of ``(total - caps before) /
    (weights from here on)`` over the sources in order of ``cap / weight``, since
    each such line lies above the sum of targets and one of them touches it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("_total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("_before", F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cap"))
        .withColumn("_left", F.sum("_w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", F.max((F.col("_total") - F.col("_before")) / F.col("_left")).over(every))
        .withColumn("target", F.least("_cap", F.greatest(F.lit(0.0), F.col("_level") * F.col("_w"))))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "n_docs", "target", rate.alias("rate"))


def size_class(size: Column) -> Column:
    """A number that grows with the size, equal for sizes that share their five highest bits."""
    bits = F.length(F.bin(size))
    return (bits * 16 + F.call_function("shiftright", size, F.greatest(bits - 5, F.lit(0))).bitwiseAND(15)).cast("int")


def digest(docs: DataFrame) -> Column:
    """64 bits of all columns that Spark can hash."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()))


def _ranked(rows: DataFrame, weights: Sequence[float], share: float, most: float, seed: str) -> DataFrame:
    """``rows`` (row, id, src, none, size, tie) with source_size, target and copies."""
    slot = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("tie").cast("string"))), 1, 2), 16, 10).cast("int")
    rows = rows.withColumns({"class": size_class(F.col("size")), "slot": slot})
    source, of_class, bucket = ["src", "none"], ["src", "none", "class"], ["src", "none", "class", "slot"]
    counts = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    classes = counts.groupBy(*of_class).agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    per = classes.groupBy(*source).agg(F.sum("words").alias("size")).select(F.when(~F.col("none"), F.col("src")).alias("source"), "size")
    targets = source_targets(per, weights, share, most).select(
        F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("none"), "source_size", "target", "rate"
    )
    # The offset: 16 bits, so that adding it to a running sum is exact.
    text = F.concat(F.lit(f"{seed}:"), F.when(F.col("none"), F.lit("n")).otherwise(F.lit("s")), F.lit(":"), F.col("src"))
    offset = F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("double") / 65536.0
    before = lambda keys, by: F.sum("n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    based = classes.select(*of_class, before(source, "class").alias("class_base")).join(targets, source)
    placed = counts.select(*bucket, before(of_class, "slot").alias("slot_base")).join(based, of_class).withColumn("u", offset)
    rank = F.col("class_base") + F.col("slot_base") + F.row_number().over(Window.partitionBy(*bucket).orderBy("size", F.col("id").asc_nulls_first(), "tie"))
    upto = lambda k: F.floor(F.col("u") + F.col("rate") * k)
    copies = F.least(upto(F.col("rank")) - upto(F.col("rank") - 1), F.ceil(F.lit(float(most))))
    return rows.join(placed, bucket).withColumn("rank", rank).withColumn("copies", copies.cast("long"))


def systematic_mix(
    docs: DataFrame,
    size: Column,
    *,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    source_col: str = "source",
    tie: Column | None = None,
    prefix: str = "mix_",
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (names start with ``prefix``).

    ``tie`` tells rows of equal source, size and id apart: by default a digest of the row.
    """
    source = F.col(f"`{source_col}`")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(source, F.lit("")).alias("src"),
        source.isNull().alias("none"),
        size.cast("long").alias("size"),
        (digest(docs) if tie is None else tie).alias("tie"),
    )
    names = [f"{prefix}{x}" for x in ("size", "source_size", "target", "copies")]
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in names]
    results = [F.col(x).alias(name) for x, name in zip(("size", "source_size", "target", "copies"), names, strict=True)]
    return _ranked(rows, weights, share, most, seed).select(*kept, *results)


def mixed_documents(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    Ranks are found for (id, source, size, digest); copies then meet the documents by
    their digest. Rows of one digest count as equal: they share their copies.
    """
    scratch, key = Scratch(docs.sparkSession, "mixing"), digest(docs)
    narrow = scratch.cut(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), key.alias("tie")), "sizes")
    mixed = systematic_mix(narrow, F.col("size"), id_col="id", tie=F.col("tie"), **options)
    taken = scratch.cut(mixed.groupBy(F.col("tie").alias("key")).agg(F.sum("mix_copies").alias("copies"), F.count(F.lit(1)).alias("rows")).filter("copies > 0"), "taken")
    scratch.drop(narrow)
    own = [F.col("row")[c].alias(c) for c in docs.columns]
    # By a shuffle at every size; the numbers are hashed, so texts need not be sorted.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key")).join(taken.hint("shuffle_hash"), "key")
    share = F.col("copies")
    if not taken.filter("rows > 1").isEmpty():
        turn = F.when(F.col("rows") > 1, F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))).otherwise(1)
        share = F.floor(F.col("copies") / F.col("rows")) + (turn <= F.col("copies") % F.col("rows")).cast("long")
    return rows.withColumn("share", share).select(F.explode(F.array_repeat(F.col("row"), F.col("share").cast("int"))).alias("row")).select(*own)
