"""Schemas of the tables that operators pass on: ``schema.BLOCKS`` and so on, built when first asked for."""

from __future__ import annotations

from functools import cache

from pyspark.sql.types import StructType

_DDL: dict[str, str] = {}
BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"

#: Blocks of documents. ``ord`` is the order of a block in its document.
_DDL["BLOCKS"] = f"""block_id string, document_id string, modality string, content string, page_number int, ord long,
    section_hierarchy array<string>, section_id string, position_in_section int, bounding_box {BBOX}, page_range struct<start:int,end:int>,
    text_metadata struct<paragraph_number:int,text_type:string,heading_level:int,has_cross_references:boolean,font_size:double,is_bold:boolean>,
    table_metadata struct<table_id:string,table_title:string,units:string,footnote_refs:array<string>>,
    figure_metadata struct<figure_id:string,figure_type:string,image_path:string,caption:string,panel_titles:array<string>>,
    footnote struct<marker:string,normalized_marker:string>,
    citation_short string, citation_section string, citation_full string, content_length int, is_complete boolean,
    continuation_of string, continued_by string, extraction_confidence double, extraction_warnings array<string>"""

_DDL["RELATIONSHIPS"] = "relationship_id string, source_block_id string, target_block_id string, relationship_type string, reference_text string, source_position struct<start:int,end:int>"

_DDL["CHUNKS"] = """chunk_id string, parent_block_id string, document_id string, ord long, chunk_index int, total_chunks int, is_complete boolean, modality string,
    sub_type string, content string, embedding_input string, content_length int, page_number int, section_hierarchy array<string>, section_path string,
    table_id string, figure_id string, footnote_marker string, panel_titles array<string>, confidence double"""

_DDL["INDEX"] = """chunk_id string, parent_block_id string, document_id string, modality string, page_number int, section_path string, section_level_0 string,
    section_level_1 string, table_id string, figure_id string, chunk_index int, total_chunks int, extraction_confidence double,
    ord long, document string, content_lc string, vector array<double>"""

_DDL["QUERIES"] = "query_id string, query string"

#: What page readers hand over: spans, grids, images and words with their places.
_DDL["SPANS"] = """document_id string, page_number int, block_no int, line_no int, span_no int, text string, font_size double, font_name string,
    is_bold boolean, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double"""
_DDL["GRIDS"] = f"document_id string, page_number int, table_no int, grid array<array<string>>, title string, bbox {BBOX}, error string"
_DDL["IMAGES"] = f"document_id string, page_number int, image_no int, width int, height int, image_path string, text_above string, text_below string, bbox {BBOX}"
_DDL["WORDS"] = "document_id string, page_number int, image_no int, word_no int, line_no int, text string, confidence double"
_DDL["PAGES"] = "path string, document_id string, page_number int, total_pages int, status string, error string"


@cache
def _schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])


def __getattr__(name: str) -> StructType:
    if name in _DDL:
        return _schema(name)
    raise AttributeError(name)
