"""Answers for a page: what can be read as a table becomes one (F47). Markup only; how it looks is the page's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.tables import let

_NUMBER, _YEAR = r"(-?\d+\.?\d*)", r"\b(20\d{2})\b"


def _tag(name: str, inner: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))


def html_table(header: Column, rows: Column) -> Column:
    """Cells lose what is left of bold marks."""
    cells = lambda row, name: F.array_join(F.transform(row, lambda c: _tag(name, F.trim(F.regexp_replace(c, r"\*+", "")))), "")
    body = F.array_join(F.transform(rows, lambda row: _tag("tr", cells(row, "td"))), "")
    return _tag("table", F.concat(_tag("thead", _tag("tr", cells(header, "th"))), _tag("tbody", body)))


def badge(modality: Column) -> Column:
    return F.concat(F.lit('<span class="modality-'), F.lower(modality), F.lit('">'), F.upper(modality), F.lit("</span>"))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _piped(text: Column) -> Column:
    """Rows between pipes, rules left out."""
    rows = F.filter(_lines(text), lambda x: F.contains(x, F.lit("|")) & ~F.regexp_like(x, F.lit(r"^[|\-:\s]+$")))
    cut = F.filter(F.transform(rows, lambda x: F.filter(F.transform(F.split(x, r"\|"), lambda c: F.trim(c)), lambda c: c != "")), lambda r: F.size(r) > 0)
    return let(cut, lambda r: F.when((F.regexp_count(text, F.lit(r"\|")) >= 4) & (F.size(r) >= 2), html_table(F.get(r, 0), F.slice(r, 2, F.size(r)))))


def _bold(text: Column) -> Column:
    """Bold labels and the values after them."""
    pattern = F.lit(r"\*\*([^*]+)\*\*[:\s]+([^\n*]+)")
    pairs = F.zip_with(F.regexp_extract_all(text, pattern, 1), F.regexp_extract_all(text, pattern, 2), lambda a, b: F.array(F.trim(a), F.trim(b)))
    intro = F.trim(F.get(F.split(text, r"\*\*"), 0))
    table = lambda p: F.concat(F.when(F.length(intro) > 15, _tag("p", intro)).otherwise(""), html_table(F.array(F.lit("Indicator"), F.lit("Value")), p))
    return let(pairs, lambda p: F.when(F.size(p) >= 2, table(p)))


def _yearly(text: Column, intent: Column) -> Column:
    """Lines of numbers below a line of years; other lines come before the table."""

    def table(lines: Column, at: Column) -> Column:
        years = F.regexp_extract_all(F.get(lines, at), F.lit(_YEAR), 1)

        def below(ys: Column) -> Column:
            rest = F.transform(F.slice(lines, at + 2, F.size(lines)), lambda x: F.struct(x.alias("line"), F.regexp_extract_all(x, F.lit(_NUMBER), 1).alias("v"), F.trim(F.regexp_replace(F.regexp_extract(x, r"^(.*?)\s*-?\d", 1), r"\*+", "")).alias("label")))
            full = F.filter(rest, lambda r: F.size(r["v"]) >= F.size(ys))
            rows = F.transform(full, lambda r: F.concat(F.array(F.when(F.length(r["label"]) < 2, "Value").otherwise(r["label"])), F.slice(r["v"], F.size(r["v"]) - F.size(ys) + 1, F.size(ys))))
            before = F.transform(F.slice(lines, F.lit(1), at), lambda x: _tag("p", x))
            between = F.transform(F.filter(rest, lambda r: F.size(r["v"]) < F.size(ys)), lambda r: _tag("p", _tag("strong", r["line"])))
            return F.when(F.size(rows) > 0, F.concat(F.array_join(F.concat(before, between), "\n"), F.lit("\n"), html_table(F.concat(F.array(F.lit("Indicator")), ys), rows)))

        return F.when(at >= 0, let(years, below))

    asked = (F.lower(intent) == "table_lookup") | F.contains(F.lower(F.substring(text, 1, 100)), F.lit("table"))
    first = lambda lines: F.array_position(F.transform(lines, lambda x: F.regexp_count(x, F.lit(_YEAR)) >= 3), True).cast("int") - 1
    return F.when(asked, let(_lines(text), lambda lines: let(first(lines), lambda at: table(lines, at))))


def _listed(text: Column) -> Column:
    """Points of a list with what follows their name; up to two other lines come before the table."""
    pattern = r"^[-*\d.]+\s*\**([^:*]+)\**[:\s]+(.+)$"
    lines = F.transform(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n"), lambda x: F.trim(x))
    points = F.transform(F.filter(lines, lambda x: F.regexp_like(x, F.lit(pattern))), lambda x: F.array(F.trim(F.regexp_extract(x, pattern, 1)), F.trim(F.regexp_extract(x, pattern, 2))))
    other = F.trim(F.array_join(F.slice(F.filter(lines, lambda x: ~F.regexp_like(x, F.lit(pattern))), 1, 2), "\n"))
    return let(points, lambda p: F.when(F.size(p) >= 3, F.concat(F.when(F.length(other) > 10, _tag("p", other)).otherwise(""), html_table(F.array(F.lit("Item"), F.lit("Details")), p))))


def answer_html(text: Column, intent: Column) -> Column:
    """the first of four readings as a table that fits (pipes, bold labels, years, lists), else the text."""
    return F.when(F.length(text) < 10, text).otherwise(F.coalesce(_piped(text), _bold(text), _yearly(text, intent), _listed(text), text))
