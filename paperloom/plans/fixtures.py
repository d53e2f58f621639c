"""Small hand-made rows as SQL ``VALUES``, read by Spark and by DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _values(rows: list[tuple], spark: bool = False) -> str:
    """Rows as literals; Spark escapes quotes, backslashes and line feeds, DuckDB doubles quotes."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + (x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") if spark else x.replace("'", "''")) + "'"
        return str(x).lower() if isinstance(x, bool) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


#: name: (columns, rows)
FIXTURES: dict[str, tuple[str, list[tuple]]] = {
    "questions": (
        "query_id, query",
        [
            ("q01", "What is the GDP growth projection in 2024?"),
            ("q02", "Show me Table 3a"),
            ("q03", "What should the authorities do about fiscal policy?"),
            ("q04", "Summarize the economic outlook"),
            ("q05", "What does Figure 2 on page 7 show?"),
            ("q06", "What is the population?"),
            ("q07", "Will it rain tomorrow?"),
            ("q08", "summary?"),
            ("q09", "show me all tables"),
            ("q10", "What does the footnote on page 12 mean"),
            ("q11", "Which constraints hold?"),
            ("q12", "the of que und le and"),
        ],
    ),
    "texts": (
        "id, text",
        [
            (1, "1. The economy grew."),
            (2, "  37.  Growth slowed"),
            (3, "CONTEXT and outlook"),
            (4, "A. Fiscal Policy"),
            (5, "Annex IV Statistics"),
            (6, "12. Short Heading"),
            (7, "• a bullet"),
            (8, "- another"),
            (9, "plain body text"),
            (10, "See Table 3 and Text Figure 8"),
            (11, "annex ii and box 4"),
            (12, "key issues"),
            (13, "1234. not a number"),
        ],
    ),
    "page_items": (
        "id, text, y, height",
        [(1, "QATAR", 400.0, 800.0), (2, "body", 20.0, 800.0), (3, "body", 780.0, 800.0), (4, "17", 300.0, 800.0), (5, "1234", 300.0, 800.0), (6, "body", 300.0, 800.0), (7, "IMF Country Report No. 1", 300.0, 800.0)],
    ),
    "linkable": (
        "block_id, document_id, modality, page_number, ord, content, section, table_id, figure_id, marker",
        [
            ("t1", "d", "TEXT", 1, 1, "As Table 1 and table 3a show, see Text Figure 8 and Annex IV.", "Staff Report", None, None, None),
            ("t2", "d", "TEXT", 2, 2, "Box 2 and Table 9 differ from Figure 3; growth 1/ was 2/ high in 2023/.", "Staff Report", None, None, None),
            ("t3", "d", "TEXT", 5, 3, "The annex includes Annex I data 4/ and 5/.", "Annexes", None, None, None),
            ("b1", "d", "TABLE", 3, 4, "Table 1. Old 1/", "Staff Report", "Table 1", None, None),
            ("b2", "d", "TABLE", 4, 5, "Table 1. New 3/", "Staff Report", "Table 1", None, None),
            ("b3", "d", "TABLE", 4, 6, "Table 3a. More", "Staff Report", "Table 3a", None, None),
            ("f1", "d", "FIGURE", 6, 7, "Text Figure 8. Lines", "Staff Report", None, "Text Figure 8", None),
            ("f2", "d", "FIGURE", 6, 8, "Figure 3. Bars", "Staff Report", None, "Figure 3", None),
            ("a1", "d", "TEXT", 51, 9, "Annex IV. Debt", "Annexes", None, None, None),
            ("x1", "d", "TEXT", 7, 10, "Box 2. Pensions", "Staff Report", None, None, None),
            ("n1", "d", "FOOTNOTE", 2, 11, "[1/] same page", "Staff Report", None, None, "1/"),
            ("n2", "d", "FOOTNOTE", 3, 12, "[2/] next page", "Staff Report", None, None, "2/"),
            ("n3", "d", "FOOTNOTE", 1, 13, "[2/] page before", "Staff Report", None, None, "2/"),
            ("n4", "d", "FOOTNOTE", 30, 14, "[3/] far", "Staff Report", None, None, "3/"),
            ("n5", "d", "FOOTNOTE", 20, 15, "[7/] nobody", "Staff Report", None, None, "7/"),
            ("n6", "d", "FOOTNOTE", 3, 16, "[4/] two before", "Staff Report", None, None, "4/"),
        ],
    ),
    "edges": (
        "relationship_id, source_block_id, target_block_id, relationship_type",
        [("r1", "t1", "b2", "cross_reference"), ("r2", "t1", "nowhere", "cross_reference"), ("r3", "t2", "t2", "cross_reference"), ("", "t2", "b3", "footnote"), ("r5", None, "b3", "")],
    ),
    "checked": (
        "block_id, document_id, modality, page_number, content, content_length, confidence, sections, x0, x1, short",
        [
            ("ok", "d", "TEXT", 1, "abc", 3, 1.0, "Staff Report", 0.1, 0.5, "Page 1"),
            ("", "", "TEXT", 0, "", 0, 1.5, None, None, None, ""),
            ("bad", "d", "VIDEO", None, "abc", 4, 0.4, "Staff Report", 0.9, 0.2, "Page 1"),
            ("tab", "d", "TABLE", 2, "x", 1, 0.7, "Staff Report", None, None, "Page 2"),
        ],
    ),
    "cells": ("id, cell", [(1, "1,234"), (2, "(5.3)"), (3, "12%"), (4, "$7"), (5, "abc"), (6, ""), (7, "-4.5e3"), (8, "1.2.3"), (9, "2024"), (10, "nan"), (11, "3 1/")]),
    "grids": (
        "id, r, c, cell",
        [
            *[(1, r, c, v) for r, row in enumerate((("", "2023", "2024"), ("GDP", "1.5", "2.5"), ("CPI", "3", None))) for c, v in enumerate(row)],
            *[(2, r, c, v) for r, row in enumerate((("a", "b"), ("c", "d"))) for c, v in enumerate(row)],
            *[(3, r, c, v) for r, row in enumerate((("1", "2"), ("3", "4"), ("5 1/", "**"))) for c, v in enumerate(row)],
        ],
    ),
    "markdown": (
        "id, page_number, modality, table_id, content",
        [
            (1, 9, "TABLE", "Table 3a", "| Item | 2023 | 2024 |\n|---|---|---|\n| Real GDP growth | 1.2 | 2.4 |\n| CPI inflation | 3.0 | - |"),
            (2, 10, "TABLE", "Table 10", "| | 2023 | 2024 |\n|---|---|---|\n| Growth | 5 | 6 |"),
            (3, 11, "TEXT", "", "Indicators 2022 2023 2024\nReal GDP growth       1.0  2.0  3.0\nInflation rate        4.0  5.0  6.0"),
            (4, 12, "TEXT", "", "No table here at all."),
            (5, 13, "TABLE", "Table 1", "Table 1. Words only\n| a | b |\n| c | d |"),
        ],
    ),
    "prose": (
        "id, page_number, section, content",
        [
            (1, 4, "Staff Report > Outlook", "Growth was driven by hydrocarbon exports and strong public investment over the last three years. See Table 3 for data."),
            (2, 5, "Staff Report > Outlook", "The economic outlook reflects fiscal buffers built up in earlier years of high revenue for the state. Staff should recommend reform."),
            (3, 5, "Staff Report", "Inflation fell due to lower imports prices and the outlook for the economic cycle is stable this year."),
            (4, 9, "Press Release", "The economic outlook reflects fiscal buffers built up in earlier years of high revenue for all."),
            (5, 40, "Statistical Appendix", "The economic surplus was supported by exports growth and revenue in many of the recent years."),
            (6, 10, "Annexes", "1 This economic outlook box summarizes data."),
            (7, 11, "Staff Report", "Short. The authorities' stance is important for the economic outlook."),
        ],
    ),
    "raw_spans": (
        "document_id, page_number, block_no, line_no, span_no, text, font_size, font_name, is_bold, x0, y0, x1, y1, page_width, page_height",
        [
            ("d", p, b, ln, sp, text, size, font, bold, 50.0, y, 300.0, y + 10.0, 600.0, 800.0)
            for p, b, ln, sp, text, size, font, bold, y in (
                (1, 0, 0, 0, "INTERNATIONAL MONETARY FUND", 9.5, "F1", False, 10.0),
                (1, 1, 0, 0, "CONTEXT", 14.0, "F2", True, 60.0),
                (1, 2, 0, 0, "1. Growth rose in the", 10.0, "F1", False, 90.0),
                (1, 2, 1, 0, "ﬁrst half and invest-\n ment", 10.0, "F1", False, 100.0),
                (1, 2, 1, 1, "fell", 9.0, "F2", True, 110.0),
                (1, 3, 0, 0, "while trade   held", 10.0, "F1", False, 125.0),
                (1, 4, 0, 0, "GDP too.", 10.0, "F1", False, 140.0),
                (1, 5, 0, 0, "• a bullet", 10.0, "F1", False, 200.0),
                (1, 6, 0, 0, "Table 2. Data (Percent)", 10.0, "F1", False, 300.0),
                (1, 7, 0, 0, "1/ A note on data", 8.0, "F1", False, 700.0),
                (1, 8, 0, 0, "Source: staff", 8.0, "F1", False, 715.0),
                (1, 9, 0, 0, "17", 8.0, "F1", False, 785.0),
                (2, 0, 0, 0, "Bold title", 12.0, "F2", True, 60.0),
                (2, 0, 0, 1, "here", 11.0, "F1", True, 60.0),
                (2, 1, 0, 0, "3", 6.0, "Fsuper", False, 75.0),
                (2, 2, 0, 0, "Text Figure 8. Exports, see Table 2", 10.0, "F1", False, 100.0),
                (2, 3, 0, 0, "Figure 3. Growth trend", 10.0, "F1", False, 400.0),
                (2, 4, 0, 0, "A Figure of speech", 10.0, "F1", False, 450.0),
            )
        ],
    ),
    "raw_tables": (
        "document_id, page_number, table_no, title, error, tx0, ty0, tx1, ty1",
        [("d", 1, 0, "Table 2. Data (Percent)", None, 50.0, 320.0, 550.0, 400.0), ("d", 1, 1, "", "cells lost", 50.0, 500.0, 550.0, 520.0), ("d", 2, 0, None, None, 50.0, 600.0, 550.0, 700.0)],
    ),
    "raw_cells": (
        "document_id, page_number, table_no, r, c, cell",
        [
            *[("d", 1, 0, r, c, v) for r, row in enumerate((("", "2023", "2024"), ("GDP 1/", "1.5", None), ("CPI **", "3", "4"))) for c, v in enumerate(row)],
            *[("d", 2, 0, r, c, v) for r, row in enumerate((("a", "b"), ("c", "d"))) for c, v in enumerate(row)],
        ],
    ),
    "raw_images": (
        "document_id, page_number, image_no, width, height, image_path, text_above, text_below, x0, y0, x1, y1",
        [
            ("d", 2, 0, 500, 400, "p.png", "Text Figure 8. Exports", "Source: staff", 0.08, 0.11, 0.9, 0.3),
            ("d", 2, 1, 50, 400, "s.png", "Figure 9", "", 0.1, 0.4, 0.2, 0.45),
            ("d", 2, 2, 300, 200, "q.png", "", "", 0.1, 0.6, 0.5, 0.8),
        ],
    ),
    "raw_words": (
        "document_id, page_number, image_no, word_no, line_no, text, confidence",
        [("d", 2, 0, 1, 1, "GDP", 90.0), ("d", 2, 0, 2, 1, "growth", 80.0), ("d", 2, 0, 3, 2, "2023", 95.0), ("d", 2, 0, 4, 2, "blur", 40.0), ("d", 2, 0, 5, 3, "2023", 70.0)],
    ),
    "shown": (
        "id, intent, text",
        [
            (1, "TABLE_LOOKUP", "Table 1:\n\n| a | b |\n|---|:-:|\n| **x** | 1 |\n\n| y | 2 |"),
            (2, "TEXT_SUMMARY", "Figures in short are: **GDP**: 2.4%\n**CPI**: 3 percent"),
            (3, "TABLE_LOOKUP", "Main data\nIndicator 2022 2023 2024\nReal GDP  1.0 2.0 -3.0\nFiscal\n 4 5 6"),
            (4, "UNKNOWN", "Some points follow here.\n- Growth: strong\n- **Debt**: low\n3. Trade: wide"),
            (5, "UNKNOWN", "Plain text without anything."),
            (6, "UNKNOWN", "short"),
        ],
    ),
    "replies": ("id, raw", [(1, '```json\n{"answer": "Yes.", "cited_chunks": [0, 2], "confidence": "high"}\n```'), (2, "plain text"), (3, 'Sure: {"answer": "No", "cited_chunks": []}'), (4, None), (5, "{broken")]),
    "cites": ("query_id, pos, chunk_id", [("q1", 1, "c3"), ("q1", 2, "c1"), ("q1", 3, "c3"), ("q1", 4, "c2"), ("q2", 1, "c1"), ("q2", 2, "c1")]),
    "spans": (
        "document_id, page_number, block_no, text, font_size, y0, y1, kind, para",
        [
            ("d", 1, 1, "first part", 10.0, 0.10, 0.12, "body", None),
            ("d", 1, 2, "goes on", 10.0, 0.13, 0.15, "body", None),
            ("d", 1, 3, "and on", 10.0, 0.16, 0.18, "body", None),
            ("d", 1, 4, "and ends.", 10.0, 0.19, 0.21, "body", None),
            ("d", 1, 5, "New one", 10.0, 0.22, 0.24, "body", None),
            ("d", 1, 6, "GDP rose", 10.0, 0.25, 0.27, "body", None),
            ("d", 1, 7, "far below", 10.0, 0.60, 0.62, "body", None),
            ("d", 1, 8, "Title", 14.0, 0.63, 0.65, "heading", None),
            ("d", 1, 9, "small", 8.0, 0.66, 0.68, "body", None),
            ("d", 2, 1, "page two", 8.0, 0.10, 0.12, "body", None),
            ("d", 2, 2, "runs to", 8.0, 0.13, 0.15, "body", None),
            ("d", 2, 3, "here", 8.0, 0.16, 0.18, "body", None),
        ],
    ),
    "boxes": (
        "id, x0, y0, x1, y1, u0, v0, u1, v1",
        [(1, 0.1, 0.1, 0.5, 0.5, 0.2, 0.2, 0.3, 0.3), (2, 0.1, 0.1, 0.5, 0.5, 0.5, 0.5, 0.7, 0.7), (3, 0.1, 0.1, 0.2, 0.2, 0.6, 0.6, 0.7, 0.7), (4, -0.2, 0.1, 1.3, 0.5, 0.0, 0.0, 1.0, 1.0), (5, 0.4, 0.4, 0.2, 0.6, 0.1, 0.1, 0.2, 0.2)],
    ),
    "regions": ("part, id, page_number, x0, y0, x1, y1", [("hit", 1, 1, 0.1, 0.1, 0.4, 0.2), ("hit", 2, 1, 0.6, 0.6, 0.9, 0.7), ("hit", 3, 2, 0.1, 0.1, 0.4, 0.2), ("image", 1, 1, 0.3, 0.15, 0.5, 0.5)]),
    "ocr": (
        "image_no, word_no, line_no, text, confidence",
        [(1, 1, 1, "GDP", 90.0), (1, 2, 1, "growth", 80.0), (1, 3, 2, "2023", 95.0), (1, 4, 2, "blur", 40.0), (1, 5, 3, "Percent", 70.0), (2, 1, 1, "x", 61.0)],
    ),
    "notes": ("id, text", [(1, "1 First note"), (2, "3/ Slash note"), (3, "** Stars"), (4, "Source: survey"), (5, "see 1. alpha words 2. beta words"), (6, "nothing")]),
    "titles": ("id, title, width, height", [(1, "Figure 3. Growth trend", 500, 400), (2, "Text Figure 8. Share of exports", 900, 300), (3, "Figure IV Map", 200, 200), (4, "Credit comparison", 300, 200), (5, "Process flow", 100, 0), (6, "Other", 10, 10)]),
    "specs": (
        "query_id, expected_modality, keywords, category, answer, seen",
        [
            ("e1", "text", "gdp;growth", "factual", "GDP growth was 2 percent", "TEXT"),
            ("e2", "table", "gdp;inflation;percent", "table_lookup", "Inflation fell", "TABLE;TEXT"),
            ("e3", "mixed", "", "analytical", "anything", "TEXT;TABLE"),
            ("e4", "figure", "chart", "factual", "no hit", "TEXT"),
            ("e5", "mixed", "a;b", "analytical", "a b", "TEXT"),
        ],
    ),
}


def cte(name: str) -> str:
    """``name(columns) AS (VALUES ...)`` for a WITH clause."""
    columns, rows = FIXTURES[name]
    return f"{name}({columns}) AS (SELECT * FROM (VALUES {_values(rows)}))"


def load(spark: SparkSession, name: str) -> DataFrame:
    columns, rows = FIXTURES[name]
    return spark.sql(f"SELECT * FROM VALUES {_values(rows, spark=True)} AS t({columns})")
