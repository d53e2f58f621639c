"""Links between blocks: references and footnotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Kind, pattern of a reference, whether its id is put in upper case. Fixed values.
REFERENCES = (
    ("TABLE", r"(?i)\b(Table\s+(\d+[a-z]?))\b", False),
    ("TEXT_FIGURE", r"(?i)\b(Text\s+Figure\s+(\d+))\b", False),
    ("FIGURE", r"(?i)\b(Figure\s+(\d+))\b", False),
    ("ANNEX", r"(?i)\b(Annex\s+([IVX]+))\b", True),
    ("BOX", r"(?i)\b(Box\s+(\d+))\b", False),
)


def reference_targets(blocks: DataFrame) -> DataFrame:
    """J1 build side: the last block of each document for each (ref_type, ref_id)."""
    low = F.lower("content")
    ident = lambda text, p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    table = ident(F.coalesce("table_metadata.table_id", F.lit("")), r"(?i)Table\s+(\d+[a-z]?)")
    fig = F.coalesce("figure_metadata.figure_id", F.lit(""))
    text_figure = ident(fig, r"(?i)Text\s+Figure\s+(\d+)")
    figure = ident(fig, r"(?i)^Figure\s+(\d+)")
    # An annex: no table or figure, named early in the text or in its sections.
    in_sections = F.array_join("section_hierarchy", " ")
    is_annex = ~F.col("modality").isin("TABLE", "FIGURE") & (F.contains(F.substring(low, 1, 100), F.lit("annex")) | F.contains(F.lower(in_sections), F.lit("annex")))
    annex_form = r"(?i)Annex\s+([IVX]+)"
    annex = F.when(is_annex, F.upper(F.coalesce(ident(F.substring("content", 1, 200), annex_form), ident(in_sections, annex_form))))
    box = F.when(F.contains(F.substring(low, 1, 50), F.lit("box")), ident(F.substring("content", 1, 100), r"(?i)Box\s+(\d+)"))
    keys = F.array(*(F.struct(F.lit(kind).alias("ref_type"), value.alias("ref_id")) for kind, value in (("TABLE", table), ("TEXT_FIGURE", text_figure), ("FIGURE", figure), ("ANNEX", annex), ("BOX", box))))
    each = blocks.select("document_id", "block_id", "ord", F.inline(keys)).filter("ref_id is not null")
    return each.groupBy("document_id", "ref_type", "ref_id").agg(F.max_by("block_id", F.struct("ord", "block_id")).alias("target_block_id"))


def references(blocks: DataFrame) -> DataFrame:
    """J1 probe side: every reference in a text block, in order of kind and place."""
    found = lambda kind, p, upper: F.transform(
        F.arrays_zip(F.regexp_extract_all("content", F.lit(p), 1).alias("t"), F.regexp_extract_all("content", F.lit(p), 2).alias("i")),
        lambda x, k: F.struct(F.lit(kind).alias("ref_type"), (F.upper(x["i"]) if upper else x["i"]).alias("ref_id"), x["t"].alias("reference_text"), k.alias("occurrence")),
    )
    every = F.concat(*(found(*r) for r in REFERENCES))
    return blocks.filter("modality = 'TEXT'").select("document_id", F.col("block_id").alias("source_block_id"), "ord", F.inline(every))


def cross_references(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relationships, unresolved). A reference to its own block is unresolved.

    Both sides are keyed by document, type and id. Ids of edges carry an ordinal, since
    the same pair may be linked more than once.
    """
    joined = references(blocks).join(reference_targets(blocks), ["document_id", "ref_type", "ref_id"], "left")
    ok = F.col("target_block_id").isNotNull() & (F.col("target_block_id") != F.col("source_block_id"))
    nth = F.row_number().over(Window.partitionBy("source_block_id", "target_block_id").orderBy("ref_type", "occurrence"))
    edges = joined.filter(ok).withColumn("nth", nth)
    ident = F.concat(F.lit("xref_"), F.substring(F.sha2(F.concat_ws("|", "source_block_id", "target_block_id"), 256), 1, 16), F.lit("_"), F.col("nth").cast("string"))
    linked = edges.select(ident.alias("relationship_id"), "source_block_id", "target_block_id", F.lit("cross_reference").alias("relationship_type"), "reference_text")
    missing = joined.filter(~F.coalesce(ok, F.lit(False))).select("source_block_id", "ref_type", "ref_id", "reference_text")
    return linked, missing


def footnote_markers(blocks: DataFrame) -> DataFrame:
    """Markers like ``3/`` in blocks other than footnotes."""
    marks = F.regexp_extract_all("content", F.lit(r"(\d+/)"), 1)
    return blocks.filter("modality != 'FOOTNOTE'").select("document_id", F.col("block_id").alias("source_block_id"), "modality", "page_number", F.posexplode(marks).alias("position", "marker")).withColumn("norm", T.normalize_marker(F.col("marker")))


def footnote_targets(blocks: DataFrame) -> DataFrame:
    """The last footnote block of each document, marker and page; and when it was first seen."""
    f = blocks.filter("modality = 'FOOTNOTE' and footnote.normalized_marker is not null").select("document_id", "block_id", "ord", F.col("footnote.normalized_marker").alias("norm"), F.col("page_number").alias("note_page"))
    return f.groupBy("document_id", "norm", "note_page").agg(F.max_by("block_id", F.struct("ord", "block_id")).alias("target_block_id"), F.min("ord").alias("first_ord"))


def nearest_footnotes(blocks: DataFrame) -> DataFrame:
    """Each marker with its footnote: same page, then one page on, one back, two on, two back, else the first.

    An equi-join on document and marker; the best of a marker's few pages is taken
    by a minimum, which combines before it is shuffled.
    """
    delta = F.col("note_page") - F.col("page_number")
    choice = F.when(delta == 0, 0).when(delta == 1, 1).when(delta == -1, 2).when(delta == 2, 3).when(delta == -2, 4).otherwise(5)
    near = footnote_markers(blocks).join(footnote_targets(blocks), ["document_id", "norm"], "left").withColumn("choice", choice)
    keys = ["document_id", "source_block_id", "modality", "page_number", "position", "marker", "norm"]
    return near.groupBy(*keys).agg(F.min_by(F.struct("target_block_id", "choice"), F.struct("choice", "first_ord")).alias("b")).select(*keys, "b.target_block_id", "b.choice")


def footnote_links(blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(relationships, orphan footnotes, orphan markers)."""
    near = nearest_footnotes(blocks)
    ident = F.concat(F.lit("fn_"), F.substring(F.sha2(F.concat_ws("|", "source_block_id", "target_block_id"), 256), 1, 16), F.lit("_"), F.col("position").cast("string"))
    found = near.filter("target_block_id is not null")
    links = found.select(ident.alias("relationship_id"), "source_block_id", "target_block_id", F.lit("footnote").alias("relationship_type"), F.col("marker").alias("reference_text"))
    notes = blocks.filter("modality = 'FOOTNOTE'").select("block_id", F.col("footnote.marker").alias("marker"), "page_number")
    orphans = notes.join(found.select(F.col("target_block_id").alias("block_id")).distinct(), "block_id", "left_anti")
    lost = near.filter("target_block_id is null").filter((F.length("norm") <= 2) & F.col("modality").isin("TEXT", "TABLE")).select("source_block_id", "marker", "page_number")
    return links, orphans, lost


def relationship_issues(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(relationship_id, field, message) of what is wrong with edges."""
    known = blocks.select("block_id").distinct()
    e = edges.join(known.select(F.col("block_id").alias("source_block_id"), F.lit(True).alias("_s")), "source_block_id", "left").join(known.select(F.col("block_id").alias("target_block_id"), F.lit(True).alias("_t")), "target_block_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    issue = lambda when, field, message: F.when(when, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))
    names = ("relationship_id", "source_block_id", "target_block_id", "relationship_type")
    rules = [issue(empty(c), c, "required field is empty") for c in names]
    rules += [issue(~empty("source_block_id") & F.col("_s").isNull(), "source_block_id", "block not found"), issue(~empty("target_block_id") & F.col("_t").isNull(), "target_block_id", "block not found")]
    rules += [issue(~empty("source_block_id") & (F.col("source_block_id") == F.col("target_block_id")), "source_block_id/target_block_id", "self-reference")]
    return e.select("relationship_id", F.inline(F.array_compact(F.array(*rules))))


def valid_relationships(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edges whose ends are known and differ."""
    known = blocks.select("block_id").distinct()
    ends = edges.filter("source_block_id != target_block_id").join(known.withColumnRenamed("block_id", "source_block_id"), "source_block_id", "left_semi")
    return ends.join(known.withColumnRenamed("block_id", "target_block_id"), "target_block_id", "left_semi")


def outside_regions(hits: DataFrame, images: DataFrame) -> DataFrame:
    """Figure texts that no image of their page overlaps; the page is the key, boxes the rest."""
    from ..functions import geometry as G

    i = images.select(F.col("document_id").alias("_d"), F.col("page_number").alias("_p"), F.col("bbox").alias("_b"))
    return hits.join(i, (F.col("document_id") == F.col("_d")) & (F.col("page_number") == F.col("_p")) & G.intersects(F.col("bbox"), F.col("_b")), "left_anti")
