"""Tables: grids of strings, markdown and aligned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with the value named once, so that expressions do not multiply."""
    return F.get(F.transform(F.array(value), use), 0)


def is_numeric(cell: Column) -> Column:
    """a number, with separators, percent, dollar or brackets around it."""
    t = F.regexp_replace(F.trim(cell), "[,%$]", "")
    t = F.trim(F.regexp_replace(t, r"^\((.*)\)$", "-$1"))
    return F.coalesce(F.regexp_like(t, F.lit(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$")), F.lit(False))


def header_rows(grid: Column, parity: bool = False) -> Column:
    """number of rows before the first whose cells are mostly numbers.

    If no row is, the first row alone is the header; with ``parity`` all rows are
    header and data at once, which callers get as -1.
    """
    mostly = F.transform(grid, lambda row: F.size(F.filter(row, is_numeric)) > F.size(row) / 2)
    at = F.array_position(mostly, True).cast("int") - 1
    return F.when(at > 0, at).when(at == 0, 1).otherwise(-1 if parity else 1)


def structure(grid: Column, parity: bool = False) -> dict[str, Column]:
    """header and data rows, size, and whether cells are merged (null)."""
    n = header_rows(grid, parity)
    clean = F.transform(grid, lambda row: F.transform(row, lambda c: F.coalesce(c, F.lit(""))))
    return {
        "headers": F.when(n < 0, clean).otherwise(F.slice(clean, F.lit(1), F.greatest(n, F.lit(0)))),
        "rows": F.when(n < 0, clean).otherwise(F.slice(clean, F.greatest(n, F.lit(0)) + 1, F.greatest(F.lit(0), F.size(clean) - n))),
        "column_count": F.array_max(F.transform(grid, lambda row: F.size(row))),
        "row_count": F.size(grid),
        "has_merged_cells": F.exists(F.when(n < 0, grid).otherwise(F.slice(grid, F.greatest(n, F.lit(0)) + 1, F.greatest(F.lit(0), F.size(grid) - n))), lambda row: F.exists(row, lambda c: c.isNull())),
    }


def table_id(title: Column) -> Column:
    """F22."""
    return F.concat(F.lit("Table "), F.nullif(F.regexp_extract(title, r"(?i)Table\s+(\d+[a-z]?)", 1), F.lit("")))


def units(title: Column) -> Column:
    """what stands in brackets at the end."""
    return F.nullif(F.regexp_extract(title, r"\(([^)]+)\)\s*$", 1), F.lit(""))


def cell_marker(cell: Column) -> Column:
    """F23."""
    return F.nullif(F.regexp_extract(cell, r"\s*(\d+/)\s*$", 1), F.lit(""))


def footnote_refs(grid: Column) -> Column:
    """distinct markers of a table, sorted."""
    found = F.transform(F.flatten(grid), lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+/|\*+)"), 1))
    return F.array_sort(F.array_distinct(F.flatten(found)))


def linear_text(grid: Column) -> Column:
    """tabs and line feeds."""
    return F.array_join(F.transform(grid, lambda row: F.array_join(F.transform(row, lambda c: F.coalesce(c, F.lit(""))), "\t")), "\n")


def to_markdown(grid: Column) -> Column:
    """the first row as header, shorter rows padded to its length."""
    width = F.size(F.get(grid, 0))
    full = lambda row: F.concat(F.transform(row, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(row))))
    line = lambda row: F.concat(F.lit("| "), F.array_join(full(row), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
    rest = F.transform(F.slice(grid, F.lit(2), F.greatest(F.lit(0), F.size(grid) - 1)), line)
    return F.array_join(F.concat(F.array(line(F.get(grid, 0)), rule), rest), "\n")


def parse_markdown(text: Column, parity: bool = True) -> Column:
    """rows of cells. With ``parity`` empty cells go, which shifts the cells after them; without, they stay."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("|-") & F.contains(x, F.lit("|")))
    if parity:
        cells = F.transform(lines, lambda x: F.filter(F.transform(F.split(x, r"\|"), lambda c: F.trim(c)), lambda c: c != ""))
    else:
        inner = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\|", ""), r"\|$", ""))
        cells = F.transform(inner, lambda x: F.transform(F.split(x, r"\|"), lambda c: F.trim(c)))
    rule = lambda row: F.forall(row, lambda c: F.regexp_like(c, F.lit(r"^:?-{2,}:?$")))
    return F.filter(cells, lambda row: (F.size(row) > 0) & (~rule(row) if not parity else F.lit(True)))


def _hits(keywords: Column, label: Column) -> Column:
    low = F.lower(label)
    return F.size(F.filter(keywords, lambda k: F.contains(low, k)))


def _best(rows: Column, keywords: Column, usable) -> Column:
    """The first of the rows (label, value) with the most keywords in its label, at least one."""
    scored = F.transform(rows, lambda r, i: F.struct(F.when(usable(r), _hits(keywords, r["label"])).otherwise(0).alias("score"), (-i).alias("place"), r["label"].alias("label"), r["value"].alias("value")))
    return let(F.array_max(scored), lambda best: F.when(best["score"] > 0, best))


def _value(found: Column) -> Column:
    def clean(f: Column) -> Column:
        value = F.trim(f["value"])
        return F.when(value.isNotNull() & ~value.isin("", "-", "...", "n/a"), F.struct(F.trim(f["label"]).alias("label"), value.alias("value")))

    return let(found, clean)


def markdown_lookup(text: Column, year: Column, keywords: Column, parity: bool = True) -> Column:
    """struct(label, value) of the row that fits best in the year's column; null if there is none."""

    def in_column(rows: Column, column: Column) -> Column:
        data = F.transform(F.slice(rows, F.lit(2), F.greatest(F.lit(0), F.size(rows) - 1)), lambda r: F.struct(F.get(r, 0).alias("label"), F.get(r, column).alias("value")))
        return F.when((F.size(rows) >= 2) & year.isNotNull() & (column >= 0), _value(_best(data, keywords, lambda r: F.lit(True))))

    place = lambda rows: F.array_position(F.transform(F.get(rows, 0), lambda h: F.contains(h, year)), True).cast("int") - 1
    return let(parse_markdown(text, parity), lambda rows: let(place(rows), lambda column: in_column(rows, column)))


def text_table_score(text: Column) -> Column:
    """points of four for looking like a table."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    lines = F.split(t, "\n")
    years = F.regexp_count(text, F.lit(r"\b20\d{2}\b")) >= 2
    numbers = F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit(r"-?\d+\.?\d*")) >= 2)) >= 2
    groups = ("gdp|growth|inflation|deficit|surplus|export|import", "revenue|expenditure|balance|account|reserve", "rate|percent|ratio|index")
    words = sum((F.regexp_like(text, F.lit(f"(?i){g}")).cast("int") for g in groups), F.lit(0)) >= 2
    lengths = F.filter(F.transform(lines, lambda x: F.length(x)), lambda n: n > 10)
    mean = F.aggregate(lengths, F.lit(0.0), lambda s, n: s + n) / F.size(lengths)
    even = F.size(F.filter(lengths, lambda n: F.abs(n - mean) < mean * 0.5)) >= F.size(lengths) * 0.5
    alike = (F.size(lines) >= 3) & (F.size(lengths) > 0) & even
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in (years, numbers, words, alike)), F.lit(0))


def text_table_rows(text: Column, year: Column) -> Column:
    """(label, value) by line, the value being the number near the place of ``year`` in the header."""

    def after(lines: Column, at: Column) -> Column:
        """Rows below the header, which is line ``at`` from 1."""
        place = F.instr(F.get(lines, at - 1), year) - 1
        rest = F.filter(F.transform(F.slice(lines, at + 1, F.greatest(F.lit(0), F.size(lines) - at)), lambda x: F.trim(x)), lambda x: F.length(x) >= 5)

        def rows(place: Column) -> Column:
            start = F.greatest(F.lit(0), place - 5)
            each = F.transform(
                rest,
                lambda x: F.struct(
                    F.trim(F.regexp_extract(x, r"^([A-Za-z][^0-9\n]{2,40})", 1)).alias("label"),
                    F.nullif(F.regexp_extract(F.substring(x, start + 1, place + 15 - start), r"(-?\d+\.?\d*)", 1), F.lit("")).alias("value"),
                ),
            )
            return F.when((F.size(lines) >= 2) & (at > 0) & (place >= 0), F.filter(each, lambda r: r["label"] != ""))

        return let(place, rows)

    header = lambda lines: F.array_position(F.transform(F.slice(lines, 1, 5), lambda x: F.regexp_count(x, F.lit(r"\b20\d{2}\b")) >= 2), True).cast("int")
    return let(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n"), lambda lines: let(header(lines), lambda at: after(lines, at)))


def text_table_lookup(text: Column, year: Column, keywords: Column) -> Column:
    """The same from aligned text that looks like a table."""
    found = _best(text_table_rows(text, year), keywords, lambda r: r["value"].isNotNull())
    return F.when(year.isNotNull() & (text_table_score(text) >= 2), _value(found))


def display_table(text: Column) -> Column:
    """label and the last values of up to as many years, in fixed width; other texts as they are.

    The years are those of the text in order, three at least; a line shows if it
    has a label (up to 29 characters) and as many numbers as there are years.
    """
    right = lambda xs: F.array_join(F.transform(xs, lambda v: F.lpad(v, 10, " ")), "")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\|", " ")))
    parts = F.transform(
        lines,
        lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([A-Za-z][^0-9\n]*)", 1)).alias("label"), F.regexp_extract_all(F.regexp_replace(x, r"^[A-Za-z][^0-9\n-]*", ""), F.lit(r"(-?\d+\.?\d*)"), 1).alias("v")),
    )

    def shown(years: Column, n: Column) -> Column:
        rows = F.filter(parts, lambda p: (p["label"] != "") & (F.size(p["v"]) >= n))
        head = F.concat(F.rpad(F.lit("Indicator"), 30, " "), right(years))
        line = lambda p: F.concat(F.rpad(F.substring(p["label"], 1, 29), 30, " "), right(F.slice(p["v"], F.size(p["v"]) - n + 1, n)))
        return let(rows, lambda rs: F.when((n >= 3) & (F.size(rs) > 0), F.array_join(F.concat(F.array(head), F.transform(rs, line)), "\n")).otherwise(text))

    years = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(20\d{2})\b"), 1)))
    return let(years, lambda ys: let(F.size(ys), lambda n: shown(ys, n)))
