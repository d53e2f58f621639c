"""Queries over the driver tables and fixtures, one for each operator or a few of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import tables as X
from ..functions import text as T
from ..functions import vectors as V
from ..operators import answer, chunk, evaluate, index, ingest, link, present, rerank, retrieve, validate
from ..sources.store import stored
from . import adapters as A
from . import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# --- identity, cleaning, structure ------------------------------------------


@query
def block_identity(spark, sf):
    d = A.table(spark, sf, "documents")
    page = (F.col("doc_id") % 60 + 1).cast("int")
    return d.select(
        "doc_id",
        T.document_id(F.concat(F.lit("/data/in/"), "source", F.lit(" v1.PDF"))).alias("document_id"),
        T.content_hash(F.col("text")).alias("content_hash"),
        T.block_id(F.col("source"), page, F.lit("TEXT"), F.col("text"), F.col("doc_id")).alias("block_id"),
    )


@query
def whitespace_normalize(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", F.md5(T.normalize_whitespace(F.col("text"))).alias("normal"), F.md5(T.clean_text(F.col("text"))).alias("clean"))


@query
def text_structure(spark, sf):
    t = FX.load(spark, "texts")
    level = T.heading_level(F.col("text"))
    return t.select("id", T.paragraph_number(F.col("text")).alias("paragraph"), level.alias("level"), T.text_type(F.col("text"), level).alias("kind"), T.has_cross_references(F.col("text")).alias("refers"))


@query
def document_structure(spark, sf):
    d = A.table(spark, sf, "documents")
    level = T.heading_level(F.col("text"))
    return d.select("doc_id", T.paragraph_number(F.col("text")).alias("paragraph"), level.alias("level"), T.text_type(F.col("text"), level).alias("kind"), T.has_cross_references(F.col("text")).alias("refers"))


@query
def header_footer_filter(spark, sf):
    return FX.load(spark, "page_items").filter(~T.is_header_or_footer(F.col("text"), F.col("y"), F.col("height"))).select("id", "text")


@query
def section_citations(spark, sf):
    b = A.document_blocks(spark, sf)
    return b.select("ord", F.array_join("section_hierarchy", ">").alias("section"), T.section_path(F.array(F.lit("A. Policies"), F.lit("2. Risks"), F.lit("Document"), F.lit("x"))).alias("path"), "citation_short", "citation_section", "citation_full")


@query
def sentence_stats(spark, sf):
    s = T.sentences(F.col("text"))
    return A.table(spark, sf, "documents").select("doc_id", F.size(s).alias("n"), F.aggregate(s, F.lit(0), lambda a, x: a + F.length(x)).alias("chars"))


@query
def manifest(spark, sf):
    return validate.manifest(A.all_blocks(spark, sf)).drop("warnings")


@query
def validate_blocks(spark, sf):
    c = FX.load(spark, "checked")
    rows = c.select(
        "block_id", "document_id", "modality", "page_number", F.lit(0).alias("ord"), "content", "content_length", F.col("confidence").alias("extraction_confidence"), F.when(F.col("sections").isNotNull(), F.array("sections")).otherwise(F.array()).alias("section_hierarchy"),
        F.when(F.col("x0").isNotNull(), G.box(F.col("x0"), F.lit(0.1), F.col("x1"), F.lit(0.2))).alias("bounding_box"), F.col("short").alias("citation_short"),
    )
    return validate.block_issues(A.blocks_from(rows))


@query
def valid_documents(spark, sf):
    v = validate.with_issues(A.all_blocks(spark, sf))
    return v.groupBy("modality").agg(F.count(F.lit(1)).alias("blocks"), F.count_if("is_valid").alias("valid"), F.sum(F.size("issues")).alias("issues"))


# --- chunks and index --------------------------------------------------------


@query
def chunk_documents(spark, sf):
    c = chunk.chunk_blocks(A.all_blocks(spark, sf).filter("modality != 'TABLE'"))
    return c.select("parent_block_id", "chunk_index", "total_chunks", "content_length", "is_complete", F.md5("content").alias("content"))


@query
def chunk_conversations(spark, sf):
    c = chunk.chunk_blocks(A.conversation_blocks(spark, sf))
    return c.select("parent_block_id", "chunk_index", "total_chunks", "content_length", F.md5("content").alias("content"))


@query
def chunk_tables(spark, sf):
    c = chunk.chunk_blocks(A.document_blocks(spark, sf).filter("modality = 'TABLE'"))
    return c.select("chunk_id", "parent_block_id", "chunk_index", "total_chunks", "content_length")


@query
def embedding_input(spark, sf):
    b = A.document_blocks(spark, sf)
    return b.select("ord", F.md5(chunk.embedding_input(F.col("modality"), T.section_path(F.col("section_hierarchy")), F.col("content"))).alias("input"))


@query
def mock_embedding(spark, sf):
    v = V.hash_embedding(F.col("text"))
    d = A.table(spark, sf, "documents").select("doc_id", v.alias("v"))
    return d.select("doc_id", F.size("v").alias("dim"), *(F.round(F.get("v", k), 6).alias(f"v{k}") for k in (0, 31, 32, 383)), F.round(V.norm(F.col("v")), 6).alias("norm"))


@query
def vector_health(spark, sf):
    e = A.table(spark, sf, "embeddings")
    h = V.health(F.col("embedding"))
    return e.select("vec_id", F.round(h["norm"], 4).alias("norm"), *(h[k].alias(k) for k in ("has_nan", "is_zero", "is_unit")))


@query
def index_metadata(spark, sf):
    return A.whole_index(spark, sf).select("chunk_id", "parent_block_id", "document_id", "modality", "page_number", "section_path", "section_level_0", "section_level_1", "table_id", "figure_id", "chunk_index", "total_chunks", "extraction_confidence")


@query
def modality_histogram(spark, sf):
    return index.modality_histogram(A.all_blocks(spark, sf))


@query
def duplicate_check(spark, sf):
    return index.duplicate_count(A.table(spark, sf, "documents").select(F.md5("text").alias("chunk_id")))


@query
def dimension_check(spark, sf):
    e = A.table(spark, sf, "embeddings").select(F.col("embedding").alias("vector"), F.col("vec_id").alias("ord"))
    d = index.dimension_check(e)
    return d.select("dims", "min_dim", "max_dim", *(F.round(c, 4).alias(c) for c in ("min_norm", "max_norm", "avg_norm")), "sampled")


@query
def metadata_nulls(spark, sf):
    return index.metadata_nulls(A.whole_index(spark, sf), ("chunk_id", "modality", "page_number", "table_id", "figure_id"))


@query
def section_coverage(spark, sf):
    return index.section_coverage(A.whole_index(spark, sf))


@query
def self_similarity(spark, sf):
    e = A.table(spark, sf, "embeddings")
    return index.self_similarity(e, "vec_id", "embedding").select("query_id", "nearest_id", F.round("score", 4).alias("score"))


@query
def cross_label_similarity(spark, sf):
    e = A.table(spark, sf, "embeddings")
    s = index.cross_modality_similarity(e, "label", "vec_id", "embedding")
    return s.groupBy("modality_a", "modality_b").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("similarity"), 4).alias("similarity"))


@query
def index_checks(spark, sf):
    return index.check_index(A.whole_index(spark, sf)).select("check_name", "passed", F.round("value", 4).alias("value"))


@query
def sanity_similarities(spark, sf):
    s = index.sanity_similarities(A.whole_index(spark, sf), ("the", "and"))
    return s.select(*(F.round(c, 4).alias(c) for c in ("self", "topic_table", "topic_other", "table_other")), "is_unit")


@query
def embedding_summary(spark, sf):
    chunks = chunk.chunk_blocks(A.all_blocks(spark, sf))
    return index.embedding_summary(index.embed(chunks))


# --- retrieval ---------------------------------------------------------------


def _vector_queries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = A.table(spark, sf, "embeddings")
    label = F.col("label").cast("string")
    ix = e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"), label.alias("table_id"), F.lit("").alias("figure_id"), F.lit(1).alias("page_number"))
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), label.alias("q_table_id"), F.lit(None).cast("string").alias("q_figure_id"), F.lit(None).cast("int").alias("q_page"))
    return q, ix


@query
def vector_topk_batch(spark, sf):
    q, ix = _vector_queries(spark, sf)
    return retrieve.vector_topk(q, ix, 10, filtered=False).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


@query
def vector_topk_filtered(spark, sf):
    q, ix = _vector_queries(spark, sf)
    return retrieve.vector_topk(q, ix, 5).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "rank")


def _questions(spark: SparkSession) -> DataFrame:
    return retrieve.embed_queries(retrieve.parse_queries(FX.load(spark, "questions")))


@query
def parse_queries(spark, sf):
    return retrieve.parse_queries(FX.load(spark, "questions")).select("query_id", "expected_modality", "q_table_id", "q_figure_id", "q_page", "section_hint", "intent", "in_domain")


@query
def query_guards(spark, sf):
    q = F.col("query")
    return FX.load(spark, "questions").select("query_id", T.asks_for_tables(q).alias("tables"), T.underspecified(q).alias("underspecified"), T.target_year(q).alias("year"), F.array_join(T.keywords(q, years=False), ",").alias("keywords"))


@query
def benchmark_intents(spark, sf):
    t = F.col("text")
    return A.table(spark, sf, "benchmark").select("item_id", T.intent(t).alias("intent"), T.in_domain(t).alias("in_domain"))


@query
def keyword_topk(spark, sf):
    return retrieve.keyword_topk(FX.load(spark, "questions"), A.whole_index(spark, sf), 8).select("query_id", "chunk_id", "hits", "rank")


@query
def modality_protect(spark, sf):
    return retrieve.modality_protection(retrieve.parse_queries(FX.load(spark, "questions")), A.whole_index(spark, sf), 5).select("query_id", "chunk_id", "rank")


@query
def hybrid_retrieve(spark, sf):
    return retrieve.retrieve(_questions(spark), stored(A.whole_index(spark, sf), "index"), 5, "hybrid").select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), "modality", "page_number")


@query
def rerank_fused(spark, sf):
    r = retrieve.retrieve(_questions(spark), stored(A.whole_index(spark, sf), "index"), 5, "reranked")
    parts = F.array_join(F.array_sort(F.map_keys("score_components")), ",")
    return r.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), parts.alias("signals"))


def _reranked(spark: SparkSession, sf: str) -> DataFrame:
    q = _questions(spark)
    return rerank.rerank(retrieve.hybrid(q, stored(A.whole_index(spark, sf), "index"), 4), q)


@query
def full_rerank(spark, sf):
    return _reranked(spark, sf).select("query_id", "chunk_id", "rank", "final_rank", F.round("final_score", 6).alias("final_score"), F.round("s_term_overlap", 6).alias("term_overlap"), "rank_change")


@query
def rank_movers(spark, sf):
    return rerank.before_after(_reranked(spark, sf), 5, 3).select("query_id", "part", "place", "chunk_id", F.round("score", 6).alias("score"), "rank_change")


@query
def verify_rank(spark, sf):
    r = retrieve.retrieve(_questions(spark), stored(A.whole_index(spark, sf), "index"), 10, "hybrid")
    return retrieve.table_rank(r, "Table 1", 39)


# --- links -------------------------------------------------------------------


@query
def crossref_link(spark, sf):
    linked, _ = link.cross_references(A.linkable_blocks(spark))
    return linked.select("source_block_id", "target_block_id", "reference_text")


@query
def crossref_unresolved(spark, sf):
    return link.cross_references(A.linkable_blocks(spark))[1]


@query
def footnote_nearest(spark, sf):
    return link.nearest_footnotes(A.linkable_blocks(spark)).select("source_block_id", "position", "marker", "target_block_id")


@query
def footnote_orphans(spark, sf):
    return link.footnote_links(A.linkable_blocks(spark))[1]


@query
def marker_orphans(spark, sf):
    return link.footnote_links(A.linkable_blocks(spark))[2]


@query
def document_references(spark, sf):
    linked, missing = link.cross_references(A.all_blocks(spark, sf))
    return linked.agg(F.count(F.lit(1)).alias("linked")).crossJoin(missing.agg(F.count(F.lit(1)).alias("unresolved")))


@query
def relationship_integrity(spark, sf):
    return link.relationship_issues(FX.load(spark, "edges"), A.linkable_blocks(spark))


@query
def relationship_valid(spark, sf):
    return link.valid_relationships(FX.load(spark, "edges"), A.linkable_blocks(spark)).select("relationship_id", "source_block_id", "target_block_id")


# --- tables ------------------------------------------------------------------


@query
def numeric_cell(spark, sf):
    return FX.load(spark, "cells").select("id", X.is_numeric(F.col("cell")).alias("numeric"), X.cell_marker(F.col("cell")).alias("marker"))


def _grids(spark: SparkSession) -> DataFrame:
    row = FX.load(spark, "grids").groupBy("id", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "cell"))), lambda x: x["cell"]).alias("row"))
    return row.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "row"))), lambda x: x["row"]).alias("grid"))


@query
def table_shape(spark, sf):
    s = X.structure(F.col("grid"))
    return _grids(spark).select("id", F.size(s["headers"]).alias("header_rows"), F.size(s["rows"]).alias("data_rows"), s["column_count"].alias("columns"), s["row_count"].alias("row_count"), s["has_merged_cells"].alias("merged"), F.array_join(X.footnote_refs(F.col("grid")), ",").alias("refs"))


@query
def table_markdown(spark, sf):
    return _grids(spark).select("id", X.to_markdown(F.col("grid")).alias("markdown"), X.linear_text(F.col("grid")).alias("linear"))


@query
def markdown_parse(spark, sf):
    cells = lambda rows: F.array_join(F.transform(rows, lambda r: F.array_join(r, ";")), "/")
    return FX.load(spark, "markdown").select("id", cells(X.parse_markdown(F.col("content"))).alias("cells"), cells(X.parse_markdown(F.col("content"), parity=False)).alias("kept_cells"))


@query
def markdown_documents(spark, sf):
    rows = X.parse_markdown(F.col("content"))
    return A.document_blocks(spark, sf).filter("modality = 'TABLE'").select("ord", F.size(rows).alias("rows"), F.aggregate(rows, F.lit(0), lambda a, r: a + F.size(r)).alias("cells"))


@query
def text_table_detect(spark, sf):
    s = X.text_table_score(F.col("content"))
    return FX.load(spark, "markdown").select("id", s.alias("points"), (s >= 2).alias("is_table"))


def _flat(answers: DataFrame) -> DataFrame:
    c = F.get("citations", 0)
    return answers.select("query_id", "answer_text", "answer_type", "confidence", c["chunk_id"].alias("cited"), c["quoted_text"].alias("quote"))


@query
def numeric_lookup(spark, sf):
    q, m = A.ranked_markdown(spark, "What is the inflation rate in 2024?")
    q2, m2 = A.ranked_markdown(spark, "How high was GDP growth in 2023?")
    one = answer.numeric_answers(answer.guard(m, q))
    two = answer.numeric_answers(answer.guard(m2.withColumn("query_id", F.lit("q2")), q2.withColumn("query_id", F.lit("q2"))))
    return _flat(one.unionByName(two))


@query
def table_lookup(spark, sf):
    q, m = A.ranked_markdown(spark, "Show me Table 1")
    return _flat(answer.table_answers(answer.guard(m, q)))


# --- answers -----------------------------------------------------------------


@query
def summary_candidates(spark, sf):
    q, m = A.ranked_prose(spark, "Summarize the economic outlook")
    return answer.summary_candidates(answer.guard(m, q)).select("chunk_id", "at", "sentence", "score")


@query
def summary_select(spark, sf):
    q, m = A.ranked_prose(spark, "Summarize the economic outlook")
    return _flat(answer.summary_answers(answer.guard(m, q)))


@query
def fallback_answer(spark, sf):
    q, m = A.ranked_prose(spark, "Which sector matters?")
    return _flat(answer.fallback_answers(answer.guard(m, q)))


@query
def rule_answers(spark, sf):
    q = FX.load(spark, "questions")
    m = A.ranked_prose(spark, "")[1].drop("query_id").crossJoin(q.select("query_id"))
    a = answer.rule_answers(q, m)
    return a.select("answer_id", "query_id", "query", "intent", "answer_text", "answer_type", "confidence", F.size("citations").alias("n_citations"), "sources_used", "sources_available")


@query
def prompts(spark, sf):
    q, m = A.ranked_prose(spark, "Summarize the economic outlook")
    return answer.prompts(q, m).select("query_id", "n_chunks", "prompt")


@query
def reply_parse(spark, sf):
    r = FX.load(spark, "replies").select("id", answer.parse_reply(F.col("raw")).alias("r")).filter("r is not null")
    return r.select("id", "r.answer", "r.confidence", F.array_join(F.col("r.cited_chunks").cast("array<string>"), ",").alias("cited"))


@query
def citation_forms(spark, sf):
    b = FX.load(spark, "linkable")
    return b.select("block_id", T.citation_form(F.col("table_id"), F.col("figure_id"), F.col("page_number")).alias("form"))


@query
def display_table(spark, sf):
    return FX.load(spark, "markdown").select("id", X.display_table(F.col("content")).alias("display"))


@query
def policy_sentence(spark, sf):
    q, m = A.ranked_prose(spark, "What policy does staff recommend?")
    return _flat(answer.policy_answers(answer.guard(m, q)))


@query
def policy_documents(spark, sf):
    """The tables' prose is invented and holds no policy, so every seventh document begins with a sentence of it."""
    said = F.when(F.col("doc_id") % 7 == 0, "Staff urge reform of the budget. ").when(F.col("doc_id") % 7 == 3, "The authorities' stance is that reform is essential! ").otherwise("")
    s = A.table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.concat(said, F.col("text")))).alias("at", "sentence"))
    return s.filter(T.is_policy(F.col("sentence"))).select("doc_id", "at", T.policy_attribution(F.col("sentence")).alias("attribution"), F.length("sentence").alias("chars"))


@query
def relevant_sentences(spark, sf):
    s = FX.load(spark, "prose").select("id", F.posexplode(T.sentences(F.col("content"))).alias("at", "sentence"))
    words = F.array(F.lit("economic"), F.lit("outlook"))
    return s.filter(T.is_relevant(F.col("sentence"), words)).select("id", "at", "sentence")


@query
def sentence_overlap(spark, sf):
    p = FX.load(spark, "prose")
    b = p.select((F.col("id") - 1).alias("id"), F.col("content").alias("next"))
    return p.join(b, "id").select("id", F.round(T.token_overlap(F.col("content"), F.col("next")), 6).alias("overlap"))


@query
def citation_registry(spark, sf):
    return answer.citation_registry(FX.load(spark, "cites"))


@query
def answer_end_to_end(spark, sf):
    """Blocks, chunks, index, reranked retrieval and rules, for a batch of questions."""
    ix = stored(index.build_index(chunk.chunk_blocks(A.all_blocks(spark, sf))), "index")
    q = _questions(spark)
    ranked = stored(retrieve.retrieve(q, ix, 10, "reranked"), "ranked")  # a few rows for each question, read by every rule
    a = answer.rule_answers(q, ranked)
    return a.select("answer_id", "query_id", "query", "intent", "answer_text", "answer_type", "confidence", F.size("citations").alias("n_citations"), "sources_used", "sources_available")


# --- pages -------------------------------------------------------------------


@query
def paragraph_merge(spark, sf):
    s = FX.load(spark, "spans").select("document_id", "page_number", "block_no", "text", "font_size", F.col("kind").alias("text_type"), F.col("para").cast("int").alias("paragraph_number"), G.box(F.lit(0.1), F.col("y0"), F.lit(0.9), F.col("y1")).alias("bbox"))
    return ingest.merge_paragraphs(s).select("page_number", "block_no", "text", "merged", F.round("bbox.y1", 4).alias("y1"))


def _grids_of_pages(spark: SparkSession) -> DataFrame:
    cells = FX.load(spark, "raw_cells").groupBy("document_id", "page_number", "table_no", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "cell"))), lambda x: x["cell"]).alias("row"))
    grid = cells.groupBy("document_id", "page_number", "table_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "row"))), lambda x: x["row"]).alias("grid"))
    none = F.array().cast("array<array<string>>")
    return FX.load(spark, "raw_tables").join(grid, ["document_id", "page_number", "table_no"], "left").withColumn("grid", F.coalesce("grid", none)).withColumn("error", F.col("error").cast("string"))


def _images_of_pages(spark: SparkSession) -> DataFrame:
    return FX.load(spark, "raw_images").withColumn("bbox", G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


@query
def text_blocks(spark, sf):
    b = ingest.text_blocks(FX.load(spark, "raw_spans"))
    return b.select("page_number", "block_no", "text", "font_size", "font_name", "is_bold", "heading_level", "text_type", "paragraph_number", "is_header_footer", F.round("bbox.x0", 4).alias("x0"), F.round("bbox.y1", 4).alias("y1"))


@query
def text_to_blocks(spark, sf):
    b = ingest.text_to_blocks(ingest.text_blocks(FX.load(spark, "raw_spans")))
    meta = [F.col(f"text_metadata.{c}").alias(c) for c in ("text_type", "heading_level", "paragraph_number", "has_cross_references")]
    return b.select("block_id", "page_number", "position_in_section", "content", *meta, F.array_join("section_hierarchy", ">").alias("section"), "citation_section")


@query
def table_to_blocks(spark, sf):
    b = ingest.tables_to_blocks(_grids_of_pages(spark))
    return b.select("block_id", "content", "table_metadata.table_id", "table_metadata.units", F.array_join("table_metadata.footnote_refs", ",").alias("refs"), "extraction_confidence", F.array_join("extraction_warnings", ",").alias("warnings"))


@query
def figure_to_blocks(spark, sf):
    b = ingest.figures_to_blocks(ingest.figures(_images_of_pages(spark)), ingest.ocr_lines(FX.load(spark, "raw_words")))
    return b.select("block_id", "content", "figure_metadata.figure_id", F.round("extraction_confidence", 4).alias("confidence"))


@query
def footnote_to_blocks(spark, sf):
    b = ingest.footnotes_to_blocks(ingest.footnotes(ingest.text_blocks(FX.load(spark, "raw_spans"))))
    return b.select("block_id", "content", "footnote.marker", "footnote.normalized_marker", "citation_short", "citation_full")


@query
def superscript_markers(spark, sf):
    return ingest.superscripts(FX.load(spark, "raw_spans")).select("page_number", "marker", F.round("bbox.x0", 4).alias("x0"))


@query
def ingest_blocks(spark, sf):
    return ingest.ingest(FX.load(spark, "raw_spans"), _grids_of_pages(spark), _images_of_pages(spark), FX.load(spark, "raw_words")).select("block_id", "modality", "content", "ord")


@query
def table_titles(spark, sf):
    boxes = FX.load(spark, "raw_tables").select("document_id", "page_number", "table_no", F.col("tx0").alias("x0"), F.col("ty0").alias("y0"), F.col("tx1").alias("x1"), F.col("ty1").alias("y1"))
    near = ingest.text_near(boxes, FX.load(spark, "raw_spans"), "table_no")
    return near.select("page_number", "table_no", "text_above", X.table_id(F.col("text_above")).alias("table_id"))


@query
def figure_regions(spark, sf):
    r = ingest.figure_regions(FX.load(spark, "raw_spans"), _images_of_pages(spark))
    return r.select("page_number", "figure_id", "title", "extraction_confidence", F.round("bbox.y1", 4).alias("bottom"))


@query
def bbox_ops(spark, sf):
    b = FX.load(spark, "boxes").select("id", G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("a"), G.box(F.col("u0"), F.col("v0"), F.col("u1"), F.col("v1")).alias("b"))
    n = G.normalize(F.col("a"), F.lit(1.0), F.lit(1.0), flip=True)
    return b.select("id", G.is_valid(F.col("a")).alias("valid"), G.contains(F.col("a"), F.col("b")).alias("holds"), G.intersects(F.col("a"), F.col("b")).alias("meets"), F.round(G.area(F.col("a")), 6).alias("area"), F.round(n["x0"], 6).alias("nx0"), F.round(n["y0"], 6).alias("ny0"))


@query
def bbox_union(spark, sf):
    b = FX.load(spark, "boxes").select((F.col("id") % 2).alias("part"), G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("b"))
    return b.groupBy("part").agg(G.union("b").alias("u")).select("part", "u.*")


@query
def overlap_antijoin(spark, sf):
    r = FX.load(spark, "regions").select("part", "id", F.lit("d").alias("document_id"), "page_number", G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("bbox"))
    return link.outside_regions(r.filter("part = 'hit'"), r.filter("part = 'image'")).select("id", "page_number")


@query
def ocr_lines(spark, sf):
    w = FX.load(spark, "ocr").withColumn("document_id", F.lit("d")).withColumn("page_number", F.lit(1))
    o = ingest.ocr_lines(w)
    return o.select("image_no", F.array_join("labels", ";").alias("labels"), F.array_join(ingest.axis_labels(F.col("labels")), ";").alias("axis"), F.round("ocr_confidence", 4).alias("confidence"))


@query
def footnote_parse(spark, sf):
    return FX.load(spark, "notes").select("id", F.posexplode(T.parse_footnotes(F.col("text"))).alias("part", "n")).select("id", "part", "n.marker", "n.content")


@query
def figure_titles(spark, sf):
    t = F.col("title")
    return FX.load(spark, "titles").select("id", T.figure_id(t).alias("figure_id"), T.figure_type(t).alias("kind"), T.figure_panels(F.col("width"), F.col("height"), t).alias("panels"))


# --- evaluation --------------------------------------------------------------


def _results(spark: SparkSession) -> DataFrame:
    s = FX.load(spark, "specs")
    words = F.filter(F.split("keywords", ";"), lambda w: w != "")
    specs = s.select("query_id", F.lit("").alias("query"), "expected_modality", words.alias("expected_keywords"), "category")
    ranked = s.select("query_id", F.explode(F.split("seen", ";")).alias("modality"))
    answers = s.select("query_id", F.col("answer").alias("answer_text"), F.lit("DIRECT").alias("answer_type"), F.lit("HIGH").alias("confidence"), F.array(F.lit("c")).alias("citations"))
    return evaluate.evaluate(specs, ranked, answers)


@query
def eval_score(spark, sf):
    return _results(spark).select("query_id", "modality_match", "keywords_found", "keyword_score", "passed", "chunks_retrieved")


@query
def eval_report(spark, sf):
    return evaluate.report(_results(spark))


@query
def eval_by_modality(spark, sf):
    return evaluate.by_modality(_results(spark))


@query
def eval_by_category(spark, sf):
    return evaluate.by_category(_results(spark))


@query
def eval_dashboard(spark, sf):
    ranked = FX.load(spark, "specs").select("query_id", F.explode(F.split("seen", ";")).alias("modality"))
    d = evaluate.dashboard(_results(spark), ranked)
    flat = lambda m, text: F.array_join(F.transform(F.array_sort(F.map_entries(m)), text), ";")
    return d.select("total", "passed", "failed", "pass_rate", flat("categories", lambda e: F.concat_ws(":", e["key"], e["value"]["total"].cast("string"), e["value"]["passed"].cast("string"))).alias("categories"), flat("modality_counts", lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))).alias("modalities"))


@query
def answer_html(spark, sf):
    return FX.load(spark, "shown").select("id", present.answer_html(F.col("text"), F.col("intent")).alias("html"))


@query
def eval_assessment(spark, sf):
    return evaluate.assessment(_results(spark))
