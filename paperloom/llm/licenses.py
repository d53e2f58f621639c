"""Operator 2: license scan as an exact set-similarity join (built-in functions only).

A template matches where a run of consecutive words, a quarter longer than the
template and on any lines, holds at least ``threshold`` of its distinct words and
those of its words that tell licenses apart (``telling``).
Blocks are overlapping stretches of the text's words, such that every run lies in
one of them. Template words are ordered by how many texts of the whole table hold
them, rarest first (any order gives the same result), and a template's prefix is the
words of which a match must hold one (``|T| - need + 1``); only blocks with such a
word are kept. Candidates come from an equi-join of block words with prefix words,
pruned by length (the block has ``need`` template words at least) and by position
(what follows the common word on either side still reaches ``need``); the runs of
each candidate are then verified.

Words outside the templates can never match, so blocks are kept as their template
words and places only. The template side is the operator's own parameter, a few
hundred words, and is the only side that is broadcast.

Besides the join, ``phrases`` are looked for as runs of consecutive words.

Edge cases: null text counts as empty (no words, no label, score 0); an empty
table yields an empty result; repeated rows are separate rows; texts are scanned
whole, with or without line feeds; other input columns are ignored. Texts that only
begin like a phrase have no place and null first and last words. Of templates with
one label, and of runs of one template, the best score counts; ties change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# The phrases of the base scan and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Label and wording of common notices.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "the person has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "copyright all rights reserved no part may be reproduced without permission"),
)
THRESHOLD = 0.8
#: Words that tell licenses apart: a template that has one matches only where it is.
TELLING = ("affero", "apache", "by", "cc", "general", "gnu", "lesser", "mit", "mozilla", "nc", "sa")

#: What separates words, before and after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _run(phrase: str) -> str:
    return f"(?<!{LETTER})" + f"{GAP}+".join(phrase.split()) + f"(?!{LETTER})"


def _any_run(phrases: Sequence[tuple[str, str]]) -> str:
    return "(?:" + "|".join(_run(p) for p, _ in phrases) + ")"


def phrase_columns(text: Column, phrases: Sequence[tuple[str, str]]) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and base_labels (array), where ``_hits`` is the number of places."""
    any_of = _any_run(phrases)
    words = lambda part: F.regexp_count(part, F.lit(f"{LETTER}+"))
    has = F.col("_hits") > 0
    before = lambda star: words(F.regexp_extract(text, f"(?is)^(.{star}){any_of}", 1))
    labels = F.array(*(F.when(F.regexp_like(text, F.lit(f"(?i){_run(p)}")), F.lit(label)) for p, label in phrases))
    none = F.lit(None).cast("long")
    return {
        "n_words": words(text).cast("long"),
        "n_base": F.col("_hits").cast("long"),
        "first_word": F.when(has, before("*?").cast("long")).otherwise(none),
        "last_word": F.when(has, before("*").cast("long")).otherwise(none),
        "base_labels": F.when(has, F.array_sort(F.array_distinct(F.array_compact(labels)))).otherwise(F.array().cast("array<string>")),
    }


def need(words: int, threshold: float) -> int:
    """Template words that a matching block must hold."""
    return max(1, math.ceil(round(threshold * words, 9)))


def run_length(template: str) -> int:
    """Consecutive words that a match may take: those of the template and a quarter for marks and insertions."""
    n = len(template.split())
    return n + max(2, n // 4)


def split_words(text: Column) -> Column:
    """Words of a text; an empty one stands before a first or after a last gap."""
    # Only A to Z count as capitals: the two other signs whose small letter is in a to z keep apart.
    plain = F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u01c0")), F.lit("\u0130"), F.lit("\u01c0"))
    return F.split(F.lower(plain), f"{GAP}+")


def texts_holding(rows: DataFrame, text: Column, vocabulary: Sequence[str]) -> dict[str, int]:
    """How many of all texts hold each of the words; words that none holds are left out."""
    held = F.array_intersect(split_words(text), F.array(*(F.lit(w) for w in vocabulary)))
    counted = rows.select(F.explode(held).alias("w")).groupBy("w").count().collect()  # a row for each template word at most
    return {r["w"]: r["count"] for r in counted}


def scan_licenses(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    threshold: float = THRESHOLD,
    telling: Sequence[str] = TELLING,
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each input row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "licenses")
    sets = [(label, sorted(set(text.split())), run_length(text)) for label, text in templates]
    vocabulary = sorted({w for _, ws, _ in sets for w in ws})
    least = min(need(len(ws), threshold) for _, ws, _ in sets)
    stride = max(n for *_, n in sets)

    text = F.col("_text")
    quick = "(?i)" + "|".join(f"{GAP}+".join(p.split()[:2]) for p, _ in phrases)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    # The quick pattern only spares texts the full one; what counts are real places.
    rows = rows.withColumn("_hits", F.when(F.regexp_like(text, F.lit(quick)), F.regexp_count(text, F.lit(f"(?i){_any_run(phrases)}"))).otherwise(0))
    cut = split_words(text)
    often = texts_holding(rows, text, vocabulary)
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}

    index, whole = [], []
    for t, (label, ws, longest) in enumerate(sets):
        ranks = sorted(rank[w] for w in ws)
        k = need(len(ws), threshold)
        whole.append((t, label, ranks, k, longest, [rank[w] for w in ws if w in telling]))
        index += [(r, t, i) for i, r in enumerate(ranks[: len(ranks) - k + 1])]
    prefixes = spark.createDataFrame(index, "rank int, t int, i int").join(spark.createDataFrame(whole, "t int, label string, ranks array<int>, need int, longest int, telling array<int>"), "t")

    # Blocks of two strides, one stride apart: (place, rank) of template words, where a prefix word is among them.
    rare = F.array(*(F.lit(order[r]) for r in sorted({r for r, _, _ in index})))
    ordered = F.array(*(F.lit(w) for w in order))
    places = lambda block: F.filter(F.transform(block, lambda w, i: F.struct(i.alias("at"), (F.array_position(ordered, w) - 1).cast("int").alias("rank"))), lambda x: x["rank"] >= 0)
    stretches = lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - 1, F.lit(stride)), lambda at: F.slice(ws, at + 1, 2 * stride))
    near = lambda ws: F.filter(stretches(ws), lambda block: F.arrays_overlap(block, rare))
    blocks = F.flatten(F.transform(F.array(cut), lambda ws: F.when(F.arrays_overlap(ws, rare), F.transform(near(ws), places)).otherwise(F.array().cast("array<array<struct<at:int,rank:int>>>"))))
    staged = scratch.cut(
        rows.select("doc_id", *(c.alias(name) for name, c in phrase_columns(text, phrases).items()), F.filter(blocks, lambda b: F.size(b) >= least).alias("_blocks")).withColumn("_row", F.monotonically_increasing_id()), "blocks"
    )

    each = staged.select("_row", F.explode("_blocks").alias("_p"))
    sorted_blocks = each.select("_row", "_p", F.array_sort(F.array_distinct(F.col("_p.rank"))).alias("_b"))
    probes = sorted_blocks.select("_row", "_p", "_b", F.posexplode("_b").alias("j", "rank"))
    pairs = probes.join(F.broadcast(prefixes), "rank").filter(
        (F.size("_b") >= F.col("need")) & (1 + F.least(F.size("ranks") - F.col("i") - 1, F.size("_b") - F.col("j") - 1) >= F.col("need"))
    )
    likely = pairs.filter(F.size(F.array_intersect("_b", "ranks")) >= F.col("need")).withColumn("_own", F.filter("_p", lambda x: F.array_contains("ranks", x["rank"])))
    run = lambda first: F.filter("_own", lambda x: (x["at"] >= first["at"]) & (x["at"] < first["at"] + F.col("longest")))
    held_in = lambda first: F.array_distinct(F.transform(run(first), lambda x: x["rank"]))
    told = F.filter(F.transform("_own", held_in), lambda ranks: F.size(F.array_except("telling", ranks)) == 0)
    shared = F.coalesce(F.array_max(F.transform(told, F.size)), F.lit(0))
    found = likely.withColumn("_shared", shared).filter(F.col("_shared") >= F.col("need"))
    per_row = found.groupBy("_row").agg(F.collect_set("label").alias("_labels"), F.max(F.col("_shared") / F.size("ranks")).alias("_held"))
    joined = staged.drop("_blocks").join(per_row, "_row", "left")
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", F.coalesce("_labels", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_held", F.lit(0.0))).alias("score"),
    )
