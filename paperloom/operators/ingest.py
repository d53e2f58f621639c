"""From what page readers hand over to blocks.

Readers emit spans, grids, images and words (see ``schema``); from there on all is
relational. Windows and groups are keyed by document and page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import tables as X
from ..functions import text as T
from .. import schema as S

PAGE = ["document_id", "page_number"]


def page_range(df: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """S3: pages from first to last, both included. Filter before a reader runs: readers get no pushed filters."""
    if first is not None:
        df = df.filter(F.col("page_number") >= first)
    return df if last is None else df.filter(F.col("page_number") <= last)


def text_blocks(spans: DataFrame) -> DataFrame:
    """Spans joined to blocks; the most common font size and font (of ties the least); bold by majority."""
    box = G.union("_b")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "span_no", "text"))), lambda s: s["text"]), " ")
    g = spans.withColumn("_b", G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).groupBy(*PAGE, "block_no").agg(
        joined.alias("text"),
        F.mode("font_size", deterministic=True).alias("font_size"),
        F.mode("font_name", deterministic=True).alias("font_name"),
        (F.count_if("is_bold") * 2 > F.count(F.lit(1))).alias("is_bold"),
        box.alias("_b"),
        F.max("page_width").alias("page_width"),
        F.max("page_height").alias("page_height"),
    )
    text = T.normalize_whitespace(T.clean_text(F.col("text")))
    level = T.heading_level(F.col("text"), F.col("font_size"), F.col("is_bold"))
    out = g.withColumn("text", text).filter("text != ''").withColumn("heading_level", level)
    return out.select(
        *PAGE,
        "block_no",
        "text",
        "font_size",
        "font_name",
        "is_bold",
        "heading_level",
        T.text_type(F.col("text"), F.col("heading_level")).alias("text_type"),
        T.paragraph_number(F.col("text")).alias("paragraph_number"),
        T.is_header_or_footer(F.col("text"), F.col("_b.y0"), F.col("page_height")).alias("is_header_footer"),
        G.normalize(F.col("_b"), F.col("page_width"), F.col("page_height")).alias("bbox"),
    )


def _merges(prev: str) -> Column:
    """Whether a block continues the one before it (columns with ``prev`` in front)."""
    p = lambda c: F.col(f"{prev}{c}")
    a, b = F.rtrim(p("text")), F.ltrim(F.col("text"))
    upper = F.regexp_like(b, F.lit(r"^\p{Lu}"))
    start = F.substring(b, 1, 3)
    acronym = (F.upper(start) == start) & (F.lower(start) != start)
    return F.coalesce(
        (p("text_type") != "heading")
        & (F.col("text_type") != "heading")
        & (F.abs(p("font_size") - F.col("font_size")) <= 0.5)
        & ~F.regexp_like(a, F.lit("[.!?:]$"))
        & (~upper | acronym)
        & F.col("paragraph_number").isNull()
        & (F.col("bbox")["y0"] - p("bbox")["y1"] <= 0.03),
        F.lit(False),
    )


def merge_paragraphs(blocks: DataFrame) -> DataFrame:
    """Adjacent blocks that belong together, two at most.

    In a run of blocks each of which continues the one before, the first pairs with
    the second, the third with the fourth: the place in the run tells.
    """
    w = Window.partitionBy(*PAGE).orderBy("block_no")
    lagged = blocks
    for c in ("text", "text_type", "font_size", "bbox"):
        lagged = lagged.withColumn(f"_p_{c}", F.lag(c).over(w))
    lagged = lagged.withColumn("_joins", _merges("_p_"))
    run = lagged.withColumn("_run", F.sum((~F.col("_joins")).cast("int")).over(w))
    place = F.row_number().over(Window.partitionBy(*PAGE, "_run").orderBy("block_no")) - 1
    keyed = run.withColumn("_pair", F.floor(place / 2)).drop("_p_text", "_p_text_type", "_p_font_size", "_p_bbox", "_joins")
    first = [c for c in blocks.columns if c not in (*PAGE, "text", "bbox")]
    out = keyed.groupBy(*PAGE, "_run", "_pair").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda s: s["text"]), " ").alias("text"),
        G.union("bbox").alias("bbox"),
        F.min_by(F.struct(*first), "block_no").alias("_f"),
        F.count(F.lit(1)).alias("merged"),
    )
    return out.select(*PAGE, "text", "bbox", *(F.col(f"_f.{c}").alias(c) for c in first), "merged")


def as_blocks(rows: DataFrame, modality: str, phase: int, *, position: str, content: Column, hashed: Column | None = None, confidence: Column | None = None, warnings: Column | None = None, title: Column | None = None, note: Column | None = None, **structs: Column) -> DataFrame:
    """Rows of one kind as blocks: ids, sections, citations, order (texts, tables, figures, notes)."""
    none = F.lit(None).cast("string")
    hierarchy = F.array(T.section_of_page(F.col("page_number")))
    r = rows.withColumn("_content", content)
    for name in ("text_metadata", "table_metadata", "figure_metadata", "footnote"):
        r = r.withColumn(f"_{name}", (structs[name] if name in structs else F.lit(None)).cast(S.BLOCKS[name].dataType))
    r = r.withColumn("_pos", F.row_number().over(Window.partitionBy(*PAGE).orderBy(position)) - 1).withColumn("_h", hierarchy)
    empty, name = F.lit(""), F.coalesce("_table_metadata.table_id", "_figure_metadata.figure_id", F.lit(""))
    cites = T.citations(F.lit(modality), F.col("page_number"), F.col("_h"), F.col("_text_metadata.paragraph_number"), name, empty if title is None else title, F.col("_footnote.marker"), F.col("_content") if note is None else note)
    hashed = F.col("_content") if hashed is None else hashed
    values = {
        "block_id": T.block_id(F.col("document_id"), F.col("page_number"), F.lit(modality), hashed, F.col("_pos")),
        "modality": F.lit(modality),
        "content": F.col("_content"),
        "ord": F.lit(phase * 10**12).cast("long") + F.col("page_number") * 10**5 + F.col("_pos"),
        "section_hierarchy": F.col("_h"),
        "section_id": none,
        "position_in_section": F.col("_pos"),
        "bounding_box": F.col("bbox") if "bbox" in rows.columns else F.lit(None),
        "page_range": F.lit(None),
        "content_length": F.length("_content"),
        "is_complete": F.lit(True),
        "continuation_of": none,
        "continued_by": none,
        "extraction_confidence": F.lit(1.0) if confidence is None else confidence,
        "extraction_warnings": F.array().cast("array<string>") if warnings is None else warnings,
        **{n: F.col(f"_{n}") for n in ("text_metadata", "table_metadata", "figure_metadata", "footnote")},
        **cites,
    }
    return r.select(*((values[f.name] if f.name in values else F.col(f.name)).cast(f.dataType).alias(f.name) for f in S.BLOCKS))


def text_to_blocks(raw: DataFrame, merge: bool = True) -> DataFrame:
    """Text blocks without running titles, paragraphs merged."""
    kept = raw.filter(~F.col("is_header_footer"))
    rows = merge_paragraphs(kept) if merge else kept
    meta = F.struct("paragraph_number", "text_type", "heading_level", T.has_cross_references(F.col("text")).alias("has_cross_references"), "font_size", "is_bold")
    return as_blocks(rows, "TEXT", 0, position="block_no", content=F.col("text"), text_metadata=meta)


def tables_to_blocks(grids: DataFrame) -> DataFrame:
    """Grids as tables in markdown below their title; failed ones keep a low confidence."""
    title = F.coalesce(F.trim("title"), F.lit(""))
    md = F.when(F.size("grid") > 0, X.to_markdown(F.col("grid"))).otherwise(F.lit(""))
    content = F.when((title != "") & (md != ""), F.concat(title, F.lit("\n\n"), md)).otherwise(F.concat(title, md))
    meta = F.struct(X.table_id(title).alias("table_id"), title.alias("table_title"), X.units(title).alias("units"), X.footnote_refs(F.col("grid")).alias("footnote_refs"))
    hashed = F.coalesce(F.nullif(title, F.lit("")), F.nullif(X.linear_text(F.col("grid")), F.lit("")), F.concat_ws("_", F.lit("table"), F.col("page_number").cast("string"), F.col("table_no").cast("string")))
    failed = F.coalesce("error", F.lit("")) != ""
    return as_blocks(grids, "TABLE", 1, position="table_no", content=content, hashed=hashed, confidence=F.when(failed, 0.5).otherwise(1.0), warnings=F.when(failed, F.array("error")).otherwise(F.array().cast("array<string>")), title=title, table_metadata=meta)


def figures(images: DataFrame, least: int = 100) -> DataFrame:
    """Images large enough, in reading order, with ids, panels and kinds."""
    big = images.filter((F.col("width") >= least) & (F.col("height") >= least))
    around = F.concat_ws("\n", "text_above", "text_below")
    title = F.coalesce(F.nullif(F.trim("text_above"), F.lit("")), F.lit(""))
    order = Window.partitionBy(*PAGE).orderBy("bbox.y0", "bbox.x0", "image_no")
    return big.withColumn("figure_no", F.row_number().over(order)).select(
        "*", title.alias("title"), T.figure_id(around).alias("figure_id"), T.figure_type(title).alias("figure_type"), T.figure_panels(F.col("width"), F.col("height"), title).alias("panel_count")
    )


def text_near(boxes: DataFrame, spans: DataFrame, key: str, above: float = 50.0, below: float = 0.0, beside: float = 0.0) -> DataFrame:
    """(document_id, page_number, ``key``, text_above, text_below): the spans in a band of so many points above and below a box, as wide as the box and ``beside``.

    ``boxes`` have x0 to y1 in page units. The join is by document and page.
    """
    b = boxes.select(*PAGE, key, *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    s = spans.select(*PAGE, "block_no", "line_no", "span_no", "text", "x0", "y0", "x1", "y1")
    within = (F.col("x0") >= F.col("b_x0") - beside) & (F.col("x1") <= F.col("b_x1") + beside)
    over = (F.col("y0") >= F.greatest(F.lit(0.0), F.col("b_y0") - above)) & (F.col("y1") <= F.col("b_y0"))
    under = (F.col("y0") >= F.col("b_y1")) & (F.col("y1") <= F.col("b_y1") + below)
    near = b.join(s, PAGE).filter(within & (over | under)).withColumn("_over", over)
    words = lambda part: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(part, F.struct("block_no", "line_no", "span_no", "text")))), lambda x: x["text"]), " ")
    found = near.groupBy(*PAGE, key).agg(words(F.col("_over")).alias("text_above"), words(~F.col("_over")).alias("text_below"))
    return boxes.select(*PAGE, key).join(found, [*PAGE, key], "left").select(*PAGE, key, F.coalesce("text_above", F.lit("")).alias("text_above"), F.coalesce("text_below", F.lit("")).alias("text_below"))


def figure_regions(spans: DataFrame, images: DataFrame, deep: float = 300.0) -> DataFrame:
    """Figures that are no images: spans that name one, outside all images, with the region below them.

    Without an id there is no figure; what is found has confidence 0.8.
    """
    where = G.normalize(G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), F.col("page_width"), F.col("page_height"))
    named = spans.filter(F.contains("text", F.lit("Figure"))).withColumn("bbox", where).withColumn("figure_id", T.figure_id(F.col("text"))).filter("figure_id is not null")
    there = images.select(*PAGE, F.col("bbox").alias("_image"))
    free = named.join(there, (named["document_id"] == there["document_id"]) & (named["page_number"] == there["page_number"]) & G.intersects(F.col("bbox"), F.col("_image")), "left_anti")
    bottom = F.least(F.col("y1") + deep, F.col("page_height") * 0.9)
    region = G.normalize(G.box(F.col("x0") - 10, F.col("y0"), F.col("page_width") * 0.9, bottom), F.col("page_width"), F.col("page_height"))
    return free.select(*PAGE, "figure_id", F.trim("text").alias("title"), F.lit("VECTOR").alias("figure_type"), region.alias("bbox"), F.lit(0.8).alias("extraction_confidence"), F.array(F.lit("Rendered from vector graphics")).alias("extraction_warnings"))


def ocr_lines(words: DataFrame, least: float = 60.0) -> DataFrame:
    """Words that are sure enough, as lines: a new one where the line number changes; labels sorted."""
    w = Window.partitionBy(*PAGE, "image_no").orderBy("word_no")
    sure = words.filter((F.col("confidence") >= least) & (F.trim("text") != ""))
    lines = sure.withColumn("_new", F.coalesce((F.col("line_no") != F.lag("line_no").over(w)).cast("int"), F.lit(1))).withColumn("_line", F.sum("_new").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ")
    each = lines.groupBy(*PAGE, "image_no", "_line").agg(text.alias("label"), F.sum("confidence").alias("_c"), F.count(F.lit(1)).alias("_n"))
    return each.groupBy(*PAGE, "image_no").agg(F.array_sort(F.collect_set("label")).alias("labels"), (F.sum("_c") / F.sum("_n")).alias("ocr_confidence"))


def axis_labels(labels: Column) -> Column:
    """Labels that look like years, numbers or units."""
    return F.filter(labels, lambda x: F.regexp_like(x, F.lit(r"(?i)^(?:(?:19|20)\d{2}|-?\d+\.?\d*%?|.*\b(?:percent|billion|million|index)\b.*)$")))


def figures_to_blocks(figs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """F16: title, caption and up to ten labels, else a plain name."""
    if labels is not None:
        figs = figs.join(labels, [*PAGE, "image_no"], "left")
    else:
        figs = figs.withColumn("labels", F.lit(None).cast("array<string>")).withColumn("ocr_confidence", F.lit(None).cast("double"))
    some = F.slice(F.coalesce("labels", F.array().cast("array<string>")), 1, 10)
    parts = F.filter(F.array(F.col("title"), F.coalesce(F.trim("text_below"), F.lit("")), F.when(F.size(some) > 0, F.concat(F.lit("Labels: "), F.array_join(some, ", "))).otherwise("")), lambda x: x != "")
    content = F.when(F.size(parts) > 0, F.array_join(parts, "\n\n")).otherwise(F.concat(F.lit("Figure on page "), F.col("page_number").cast("string")))
    hashed = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.trim("text_below"), F.lit("")), F.concat_ws("_", F.lit("figure"), F.col("page_number").cast("string"), F.col("figure_no").cast("string")))
    meta = F.struct("figure_id", "figure_type", "image_path", F.col("text_below").alias("caption"), F.array().cast("array<string>").alias("panel_titles"))
    sure = F.when(F.col("ocr_confidence").isNotNull(), 0.8 + 0.2 * F.col("ocr_confidence") / 100).otherwise(1.0)
    return as_blocks(figs, "FIGURE", 2, position="figure_no", content=content, hashed=hashed, confidence=sure, title=F.col("title"), figure_metadata=meta)


def footnotes(raw: DataFrame, band: float = 0.85) -> DataFrame:
    """Texts in the lowest part of a page as (marker, content)."""
    low = raw.filter(F.col("bbox.y0") >= band)
    return low.select(*PAGE, "block_no", "bbox", F.posexplode(T.parse_footnotes(F.col("text"))).alias("part", "_n")).select(*PAGE, (F.col("block_no") * 1000 + F.col("part")).alias("note_no"), "bbox", "_n.marker", "_n.content")


def superscripts(spans: DataFrame) -> DataFrame:
    """Digits in a small or raised font."""
    raised = (F.col("font_size") < 10) | F.contains(F.lower("font_name"), F.lit("super"))
    return spans.filter(raised & F.regexp_like(F.trim("text"), F.lit(r"^\d+$"))).select(*PAGE, F.trim("text").alias("marker"), G.normalize(G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), F.col("page_width"), F.col("page_height")).alias("bbox"))


def footnotes_to_blocks(notes: DataFrame) -> DataFrame:
    """F17, F19."""
    meta = F.struct("marker", T.normalize_marker(F.col("marker")).alias("normalized_marker"))
    rows = notes.withColumnRenamed("content", "_note").withColumn("_text", F.concat(F.lit("["), F.col("marker"), F.lit("] "), F.col("_note")))
    hashed = F.coalesce(F.nullif(F.col("_note"), F.lit("")), F.col("marker"))
    return as_blocks(rows, "FOOTNOTE", 3, position="note_no", content=F.col("_text"), hashed=hashed, note=F.col("_note"), footnote=meta)


def ingest(spans: DataFrame, grids: DataFrame, images: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Blocks of all kinds, in the order texts, tables, figures, notes."""
    raw = text_blocks(spans)
    parts = [text_to_blocks(raw), tables_to_blocks(grids), figures_to_blocks(figures(images), None if words is None else ocr_lines(words)), footnotes_to_blocks(footnotes(raw))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
