"""Chunking of blocks: greedy packing as folds over arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class ChunkConfig:
    """Limits in tokens of four characters. ``parity`` repeats the text before an oversize paragraph,
    and loses the header of a table below a title line."""

    max_tokens: int = 512
    min_tokens: int = 50
    chars_per_token: float = 4.0
    parity: bool = False

    @property
    def max_chars(self) -> int:
        return int(self.max_tokens * self.chars_per_token)

    @property
    def min_chars(self) -> int:
        return int(self.min_tokens * self.chars_per_token)


def _none() -> Column:
    return F.array().cast("array<string>")

_STATE = "struct<done:array<string>,cur:string>"


def _state(done: Column, cur: Column) -> Column:
    return F.struct(done.alias("done"), cur.alias("cur")).cast(_STATE)


def _finish(acc: Column) -> Column:
    return F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])


def _flushed(acc: Column) -> Column:
    return F.concat(acc["done"], F.when(acc["cur"] != "", F.array(acc["cur"])).otherwise(_none()))


def _joined(acc: Column, part: Column, glue: str) -> Column:
    return F.when(acc["cur"] == "", part).otherwise(F.concat(acc["cur"], F.lit(glue), part))


def _hard_split(s: Column, limit: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / limit).cast("int")), lambda i: F.substring(s, i * limit + 1, F.lit(limit)))


def pack_sentences(sentences: Column, limit: int) -> Column:
    """Sentences packed with spaces up to ``limit`` characters; longer ones are cut."""

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["cur"]) + F.length(s) + 1 <= limit
        cut = _state(F.concat(_flushed(acc), _hard_split(s, limit)), F.lit(""))
        return F.when(fits, _state(acc["done"], _joined(acc, s, " "))).when(F.length(s) > limit, cut).otherwise(_state(_flushed(acc), s))

    return F.aggregate(sentences, _state(_none(), F.lit("")), step, _finish)


def pack_paragraphs(content: Column, cfg: ChunkConfig) -> Column:
    """Paragraphs packed with blank lines; an oversize one by its sentences; short pieces go."""
    limit = cfg.max_chars
    paragraphs = F.filter(F.transform(F.split(content, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")

    def step(acc: Column, p: Column) -> Column:
        fits = F.length(acc["cur"]) + F.length(p) + 2 <= limit
        by_sentence = _state(F.concat(_flushed(acc), pack_sentences(T.sentences(p), limit)), acc["cur"] if cfg.parity else F.lit(""))
        return F.when(fits, _state(acc["done"], _joined(acc, p, "\n\n"))).when(F.length(p) > limit, by_sentence).otherwise(_state(_flushed(acc), p))

    packed = F.aggregate(paragraphs, _state(_none(), F.lit("")), step, _finish)
    kept = F.filter(packed, lambda c: F.length(c) >= cfg.min_chars)
    return F.when(F.length(content) <= limit, F.array(content)).otherwise(kept)


def pack_table(content: Column, title: Column, cfg: ChunkConfig) -> Column:
    """Table lines packed below a repeated header; pieces after the first say that they continue."""
    lines = F.split(content, "\n")
    is_rule = lambda x: F.contains(x, F.lit("---"))
    is_row = lambda x: x.startswith("|") & ~is_rule(x)
    # The header: the first row and the rule after it, where a table starts.
    first = F.array_position(F.transform(lines, is_row), True).cast("int") - 1
    ruled = F.coalesce(is_rule(F.get(lines, first + 1)), F.lit(False))
    starts = (first == 0) if cfg.parity else (first >= 0)
    header_end = F.when(starts, first + 1 + ruled.cast("int")).otherwise(0)
    header = F.when(starts, F.slice(lines, first + 1, F.lit(1) + ruled.cast("int"))).otherwise(_none())
    named = F.coalesce(title, F.lit(""))
    head = F.array_join(header, "\n")
    base = F.length(head) + F.length(named) + 10
    body = F.slice(lines, header_end + 1, F.greatest(F.lit(0), F.size(lines) - header_end))

    def step(acc: Column, x: Column) -> Column:
        # In ``cur`` each row ends with a line feed.
        fits = base + F.length(acc["cur"]) + F.length(x) + 1 <= cfg.max_chars
        row = F.concat(x, F.lit("\n"))
        return F.when(fits, _state(acc["done"], F.concat(acc["cur"], row))).otherwise(_state(_flushed(acc), row))

    pieces = F.aggregate(body, _state(_none(), F.lit("")), step, _finish)

    def dressed(p: Column, i: Column) -> Column:
        rows = F.concat(head, F.lit("\n"), F.substring(p, F.lit(1), F.length(p) - 1))
        return F.when(named == "", rows).otherwise(F.concat(named, F.when(i > 0, " (continued)").otherwise(""), F.lit("\n\n"), rows))

    return F.when(F.length(content) <= cfg.max_chars, F.array(content)).otherwise(F.transform(pieces, dressed))


def embedding_input(modality: Column, path: Column, content: Column) -> Column:
    """F31."""
    return F.concat(F.lit("["), modality, F.lit("]"), F.when(path != "", F.concat(F.lit(" "), path)).otherwise(""), F.lit("\n\n"), content)


def chunk_blocks(blocks: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of all blocks: texts and tables packed, others whole. Nothing is shuffled."""
    content = F.coalesce("content", F.lit(""))
    pieces = F.when(F.col("modality") == "TEXT", pack_paragraphs(content, cfg)).when(F.col("modality") == "TABLE", pack_table(content, F.col("table_metadata.table_title"), cfg)).otherwise(F.array(content))
    cut = blocks.withColumn("_pieces", pieces).select("*", F.posexplode("_pieces").alias("chunk_index", "_text"))
    total, path = F.size("_pieces"), T.section_path(F.col("section_hierarchy"))
    return cut.select(
        F.concat_ws("_", "block_id", F.lit("chunk"), F.col("chunk_index").cast("string"), F.substring(F.md5("_text"), 1, 8)).alias("chunk_id"),
        F.col("block_id").alias("parent_block_id"),
        "document_id",
        (F.col("ord") * 100_000 + F.col("chunk_index")).alias("ord"),
        "chunk_index",
        total.alias("total_chunks"),
        (total == 1).alias("is_complete"),
        "modality",
        F.when(F.col("modality") == "FIGURE", F.col("figure_metadata.figure_type")).when(F.col("modality") == "TEXT", F.col("text_metadata.text_type")).alias("sub_type"),
        F.col("_text").alias("content"),
        embedding_input(F.col("modality"), path, F.col("_text")).alias("embedding_input"),
        F.length("_text").alias("content_length"),
        "page_number",
        "section_hierarchy",
        path.alias("section_path"),
        F.col("table_metadata.table_id").alias("table_id"),
        F.col("figure_metadata.figure_id").alias("figure_id"),
        F.col("footnote.marker").alias("footnote_marker"),
        F.coalesce("figure_metadata.panel_titles", _none()).alias("panel_titles"),
        F.col("extraction_confidence").alias("confidence"),
    )
