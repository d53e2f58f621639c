"""Text: identity, cleaning, structure, questions, sentences."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

SENTENCE = r"(?<=[.!?])\s+"


def any_of(text: Column, phrases: Iterable[str]) -> Column:
    """Whether ``text`` holds one of the phrases."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def matches(text: Column, patterns: Sequence[str], flags: str = "") -> Column:
    """Whether ``text`` matches one of the patterns: one alternation."""
    return F.regexp_like(text, F.lit(flags + "|".join(f"(?:{p})" for p in patterns)))


def first_match(text: Column, families: Sequence[tuple[str, Sequence[str]]], flags: str = "", other: str | None = None) -> Column:
    """Name of the first family of patterns that matches."""
    out = F.lit(other)
    for name, patterns in reversed(families):
        out = F.when(matches(text, patterns, flags), F.lit(name)).otherwise(out)
    return out


# --- identity ---------------------------------------------------------------


def document_id(path: Column) -> Column:
    """the file's stem in lower case, other than letters and digits as ``_``."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.lower(F.regexp_replace(stem, r"[^\p{L}\p{N}]", "_"))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with white space normalised."""
    return F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256)


def block_id(document: Column, page: Column, modality: Column, text: Column, position: Column) -> Column:
    """``{document}_p{page}_{modality}_{hash8}_{position}``."""
    return F.format_string("%s_p%03d_%s_%s_%03d", document, page.cast("int"), F.lower(modality), F.substring(content_hash(text), 1, 8), position.cast("int"))


# --- cleaning ---------------------------------------------------------------


def normalize_whitespace(text: Column) -> Column:
    """single spaces, at most one blank line, lines trimmed."""
    one = F.regexp_replace(F.regexp_replace(text, r"[\t\r\f\x0B]+", " "), " +", " ")
    lines = F.transform(F.split(F.regexp_replace(one, r"\n{3,}", "\n\n"), "\n"), lambda x: F.trim(x))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """F8: no control characters, words joined over line ends, ligatures spelled out."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    out = F.regexp_replace(out, r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")
    for ligature, letters in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")):
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return out


# --- structure --------------------------------------------------------------

_PARAGRAPH = r"^\s*(\d{1,3})\.\s+"


def paragraph_number(text: Column) -> Column:
    """the number that a paragraph starts with."""
    return F.regexp_extract(text, _PARAGRAPH, 1).try_cast("int")


def without_paragraph_number(text: Column) -> Column:
    return F.regexp_replace(text, _PARAGRAPH, "")


def heading_level(text: Column, font_size: Column | None = None, bold: Column | None = None) -> Column:
    """1 to 3 for headings, else null; words first, then fonts."""
    t = F.trim(text)
    size, heavy = (F.lit(None).cast("double") if font_size is None else font_size), (F.lit(False) if bold is None else bold)
    short = F.regexp_like(t, F.lit(r"^\d{1,2}\.\s+[A-Z]")) & (F.length(t) < 100) & ~t.endswith(".")
    return (
        F.when(F.regexp_like(t, F.lit(r"(?i)^(?:CONTEXT|OUTLOOK|POLICIES|STAFF APPRAISAL|KEY ISSUES)")), 1)
        .when(F.regexp_like(t, F.lit(r"^[A-Z]\.\s+")), 2)
        .when(F.regexp_like(t, F.lit(r"(?i)^Annex\s+[IVX]+")), 2)
        .when(short, 3)
        .when(heavy & (size >= 14), 1)
        .when(heavy & (size >= 12), 2)
        .when(heavy & (size >= 11), 3)
    )


def text_type(text: Column, level: Column) -> Column:
    """heading, bullet or body."""
    return F.when(level.isNotNull(), "heading").when(F.regexp_like(F.trim(text), F.lit("^[•●○\\-–—]")), "bullet").otherwise("body")


def is_header_or_footer(text: Column, y: Column, height: Column) -> Column:
    """in the outer twentieth of a page, or a running title or page number."""
    at = y / height
    return (at < 0.05) | (at > 0.95) | F.regexp_like(F.trim(text), F.lit(r"(?i)^INTERNATIONAL MONETARY FUND$|^QATAR$|^\d{1,3}$|^IMF Country Report"))


def has_cross_references(text: Column) -> Column:
    """F13."""
    return F.regexp_like(text, F.lit(r"(?i)\b(?:Table\s+\d+|Figure\s+\d+|Text\s+Figure\s+\d+|Box\s+\d+|Annex\s+[IVX]+)"))


def section_of_page(page: Column, ranges: Sequence[tuple[int | None, str]] = L.SECTION_PAGES) -> Column:
    """F28."""
    out = F.lit(ranges[-1][1])
    for last, name in reversed(ranges[:-1]):
        out = F.when(page <= last, F.lit(name)).otherwise(out)
    return out


def section_path(hierarchy: Column) -> Column:
    """up to three levels without their numbering."""
    levels = F.transform(F.slice(hierarchy, 1, 3), lambda x: F.regexp_replace(x, r"^[A-Z]\.\s*|^\d+\.\s*", ""))
    return F.array_join(F.filter(levels, lambda x: ~x.isin("", "Document")), " > ")


def citations(modality: Column, page: Column, hierarchy: Column, paragraph: Column, name: Column, title: Column, marker: Column, note: Column) -> dict[str, Column]:
    """short, section and full citations. ``name`` and ``title`` are a table's or a figure's."""
    p = F.concat(F.lit("Page "), page.cast("string"))
    boxed = lambda *parts: F.concat(F.lit("["), *parts, F.lit("]"))
    named = F.coalesce(F.nullif(name, F.lit("")), F.initcap(F.lower(modality)))
    is_named, is_note, comma = modality.isin("TABLE", "FIGURE"), (modality == "FOOTNOTE") & (F.coalesce(marker, F.lit("")) != ""), F.lit(", ")
    short = F.when(is_named, boxed(named, comma, p)).when(is_note, boxed(F.lit("Footnote "), marker, comma, p)).otherwise(boxed(p))
    last = F.array_join(F.slice(hierarchy, F.greatest(F.lit(1), F.size(hierarchy) - 1), F.lit(2)), " > ")
    place = F.when(F.coalesce(paragraph, F.lit(0)) > 0, F.concat(F.lit("Para "), paragraph.cast("string"))).otherwise(p)
    section = F.when(is_named, short).when(F.size(hierarchy) > 0, boxed(last, comma, place)).otherwise(boxed(p))
    full = (
        F.when(is_named, F.concat(named, F.lit(": "), F.coalesce(title, F.lit("")), comma, p))
        .when(is_note, F.concat(F.lit("Footnote "), marker, comma, p, F.lit(": "), F.substring(note, 1, 50), F.lit("...")))
        .when(modality == "TEXT", F.when(F.size(hierarchy) > 0, F.concat(F.get(hierarchy, F.size(hierarchy) - 1), comma, p)).otherwise(p))
        .otherwise(F.concat(modality, comma, p))
    )
    return {"citation_short": short, "citation_section": section, "citation_full": full}


def citation_form(table_id: Column, figure_id: Column, page: Column) -> Column:
    """table or figure, and page."""
    name = F.coalesce(F.nullif(table_id, F.lit("")), F.nullif(figure_id, F.lit("")))
    return F.concat_ws(", ", name, F.concat(F.lit("Page "), page.cast("string")))


# --- sentences --------------------------------------------------------------


def sentences(text: Column) -> Column:
    """F32: trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, SENTENCE), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def summary_worthy(sentence: Column, section: Column) -> Column:
    """not rejected, and two of a causal phrase, a macro driver, twelve words."""
    low, where = F.lower(F.trim(sentence)), F.lower(section)
    rejected = F.regexp_like(F.trim(sentence), F.lit(r"^[\d•\-*]")) | any_of(low, L.SUMMARY_REJECT) | any_of(where, ("appendix", "statistical", "annex")) | (F.length(sentence) < 30)
    points = any_of(low, L.CAUSAL).cast("int") + any_of(low, L.MACRO).cast("int") + (F.size(word_array(sentence)) >= 12).cast("int")
    return ~rejected & (points >= 2)


def summary_score(sentence: Column, section: Column) -> Column:
    """Points of a summary candidate."""
    low, where = F.lower(sentence), F.lower(section)
    return (
        F.when(any_of(low, L.CAUSAL), 3).otherwise(0)
        + F.when(any_of(low, L.MACRO), 2).otherwise(0)
        + F.when(any_of(where, L.PREFERRED_SECTIONS), 1).otherwise(0)
        - F.when(any_of(low, L.SUMMARY_REJECT), 2).otherwise(0)
        - F.when(F.contains(where, F.lit("press release")), 1).otherwise(0)
    )


def content_words(text: Column) -> Column:
    """Distinct lower-cased words without stopwords."""
    return F.array_except(F.array_distinct(word_array(F.lower(text))), F.array(*(F.lit(w) for w in L.STOPWORDS)))


def token_overlap(a: Column, b: Column) -> Column:
    """shared content words over those of the sentence that has fewer."""
    x, y = content_words(a), content_words(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


def is_policy(sentence: Column) -> Column:
    """P6."""
    return (F.length(sentence) >= 20) & matches(F.lower(sentence), L.POLICY_PATTERNS)


def policy_attribution(sentence: Column) -> Column:
    low = F.lower(sentence)
    return F.when(F.contains(low, F.lit("authorities")), "authorities").when(F.contains(low, F.lit("staff")), "staff").otherwise("general")


def is_relevant(sentence: Column, keywords: Column) -> Column:
    """P5: long enough, not rejected, two keywords or more."""
    low = F.lower(sentence)
    hits = F.size(F.filter(keywords, lambda k: F.contains(low, k)))
    return (F.length(sentence) >= 20) & ~matches(sentence, L.RELEVANT_REJECT, "(?i)") & (hits >= 2)


# --- questions --------------------------------------------------------------


def query_tokens(query: Column) -> Column:
    """Words of a question for the rules."""
    return word_array(F.replace(F.replace(query, F.lit("?"), F.lit("")), F.lit("'s"), F.lit(" ")))


def keywords(query: Column, years: bool = True) -> Column:
    """Lower-cased tokens of more than two characters; without years on request."""
    long = F.filter(query_tokens(query), lambda t: F.length(t) > 2)
    kept = long if years else F.filter(long, lambda t: ~F.regexp_like(t, F.lit(r"^20\d{2}")))
    return F.transform(kept, lambda t: F.lower(t))


def target_year(query: Column) -> Column:
    """The first token that starts with a year, whole."""
    return F.get(F.filter(query_tokens(query), lambda t: F.regexp_like(t, F.lit(r"^20\d{2}"))), 0)


def intent(query: Column) -> Column:
    """F39."""
    return first_match(F.lower(query), L.INTENTS, other="UNKNOWN")


def in_domain(query: Column) -> Column:
    """substrings, as in the word lists; topics outside come first."""
    low = F.lower(query)
    return ~any_of(low, L.OUT_OF_DOMAIN) & any_of(low, L.IN_DOMAIN)


def asks_for_tables(query: Column) -> Column:
    """A question about tables in general."""
    return F.regexp_like(F.lower(query), F.lit(r"\btables\b"))


def underspecified(query: Column) -> Column:
    """A summary of nothing in particular."""
    words = F.transform(F.filter(query_tokens(query), lambda t: ~t.isin("?", ".", ",", "!")), lambda t: F.lower(t))
    generic = F.forall(words, lambda t: t.isin(*L.GENERIC_WORDS))
    return ((F.size(words) <= 2) | generic) & ~any_of(F.lower(query), L.ANCHORS)


def parsed(query: Column) -> dict[str, Column]:
    """what a question says about modality, ids, page and section."""
    low = F.lower(query)
    table = F.nullif(F.regexp_extract(query, r"(?i)\btable\s+(\d+[a-z]?)", 1), F.lit(""))
    figure = F.nullif(F.regexp_extract(query, r"(?i)\bfigure\s+(\d+)", 1), F.lit(""))
    section = F.lit(None).cast("string")
    for word in reversed(L.SECTION_WORDS):
        section = F.when(F.contains(low, F.lit(word)), F.lit(word.title())).otherwise(section)
    return {
        "expected_modality": first_match(query, L.QUERY_MODALITIES, "(?i)"),
        "q_table_id": F.concat(F.lit("Table "), table),
        "q_figure_id": F.concat(F.lit("Figure "), figure),
        "q_page": F.regexp_extract(query, r"(?i)\bpage\s+(\d+)", 1).try_cast("int"),
        "section_hint": section,
    }


# --- markers and ids --------------------------------------------------------


def normalize_marker(marker: Column) -> Column:
    """F19."""
    return F.regexp_replace(marker, "/+$", "")


def parse_footnotes(text: Column) -> Column:
    """array of (marker, content): one of three forms, else several in one text, else a source note."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    one = lambda p: F.array(F.struct(F.regexp_extract(t, p, 1).alias("marker"), F.trim(F.regexp_extract(t, p, 2)).alias("content")))
    out = F.array().cast("array<struct<marker:string,content:string>>")
    several = r"(\d+)[.\s]+([^0-9]+?)(?=\d+[.\s]|$)"
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(several), 1), F.regexp_extract_all(text, F.lit(several), 2), lambda m, c: F.struct(m.alias("marker"), F.trim(c).alias("content")))
    source = F.when(F.regexp_like(text, F.lit(r"(?i)^(?:source|note:)")), F.array(F.struct(F.lit("source").alias("marker"), text.alias("content")))).otherwise(out)
    result = F.when(F.size(pairs) > 0, pairs).otherwise(source)
    for p in (r"^(\*+)\s*(.+)$", r"^(\d+/)\s*(.+)$", r"^(\d+)[.\s]+(.+)$"):
        result = F.when(F.regexp_like(t, F.lit(p)), one(p)).otherwise(result)
    return result


def figure_id(text: Column) -> Column:
    """first of three forms."""
    found = [F.nullif(F.regexp_extract(text, f"(?i)({p})", 1), F.lit("")) for p in (r"Text\s+Figure\s+\d+", r"Figure\s+\d+[a-z]?", r"Figure\s+[IVX]+")]
    return F.coalesce(*found)


def figure_panels(width: Column, height: Column, title: Column) -> Column:
    """F26."""
    main = F.regexp_like(title, F.lit(r"(?i)^Figure\s+[1-5]\b")) & (width > 400) & (height > 300)
    return F.when(main, 6).when(width / F.greatest(height, F.lit(1)) > 2.0, 2).otherwise(1)


def figure_type(title: Column) -> Column:
    """F27."""
    low = F.lower(title)
    return (
        F.when(any_of(low, ("chart", "trend", "growth")), "LINE_CHART")
        .when(any_of(low, ("bar", "comparison")), "BAR_CHART")
        .when(any_of(low, ("pie", "share", "composition")), "PIE_CHART")
        .when(any_of(low, ("map",)), "MAP")
        .when(any_of(low, ("diagram", "flow", "process")), "DIAGRAM")
        .otherwise("CHART")
    )
