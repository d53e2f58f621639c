"""Default word lists, patterns and limits. Callers may pass their own."""

from __future__ import annotations

# Modalities and edge types.
MODALITIES = ("TEXT", "TABLE", "FIGURE", "BOX", "ANNEX", "FOOTNOTE")
EDGE_TYPES = ("cross_reference", "footnote", "parent_child", "continuation", "supports")

# Words that put a question in the domain, and topics that put it out.
IN_DOMAIN = (
    "economy", "economic", "fiscal", "monetary", "financial", "gdp", "growth", "inflation", "deficit", "surplus", "revenue", "expenditure",
    "budget", "debt", "reserve", "currency", "exchange", "trade", "export", "import", "qatar", "qatari", "doha", "gcc", "gulf",
    "policy", "policies", "reform", "regulation", "tax", "vat", "government", "authorities", "imf", "staff", "article",
    "outlook", "forecast", "projection", "risk", "indicator", "table", "figure", "annex", "appendix", "sector", "bank", "investment", "infrastructure",
    "rate", "percent", "billion", "million", "index", "ratio",
)
OUT_OF_DOMAIN = (
    "weather", "temperature", "rain", "sunny", "cloudy", "football", "soccer", "sports", "movie", "music", "concert",
    "hotel", "flight", "restaurant", "tourist", "vacation", "tourism", "recipe", "health", "doctor", "hospital", "school",
    "phone", "laptop", "computer", "game", "gaming", "population", "census", "demographics",
)

# Sections that summaries prefer.
PREFERRED_SECTIONS = ("outlook", "outlook and risks", "staff report", "context", "recent economic developments", "policies")

# Patterns of policy sentences.
POLICY_PATTERNS = (
    r"\brecommend", r"\brecommendation", r"\bshould\b", r"\bauthorities'", r"\bstaff's assessment", r"\bcommitment to", r"\bfiscal discipline",
    r"\bpolicy stance", r"\bmedium-term fiscal", r"\bconsolidation", r"\burge", r"\bsuggest", r"\bencourage", r"\badvised",
    r"\bis critical", r"\bis essential", r"\bis important",
)

# Phrases for choosing summary sentences.
CAUSAL = (
    "driven by", "supported by", "reflects", "due to", "as a result of", "contributes to", "led to", "resulted in", "attributed to", "caused by",
    "boosted by", "offset by", "constrained by", "underpinned by",
)
MACRO = (
    "growth", "inflation", "fiscal", "buffers", "external", "hydrocarbon", "non-hydrocarbon", "exports", "imports", "surplus", "deficit", "gdp",
    "monetary", "revenue", "expenditure", "investment", "consumption",
)
SUMMARY_REJECT = (
    "this box", "summarizes", "figure", "table", "staff concur", "authorities broadly concur", "broadly concurred", "concurred with",
    "outlined in", "appendix", "methodology", "dataset", "authors", "selected issues", "see box", "see figure", "see table",
)
STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "to", "of", "in", "for", "on", "with", "at", "by", "from",
    "and", "or", "but", "as", "if", "that", "this", "it",
)
GENERIC_WORDS = (
    "summary", "summarize", "summarise", "brief", "overview", "the", "a", "an", "is", "of", "in", "to", "for", "please",
    "what", "give", "me", "can", "you", "document", "text", "full", "complete",
)
ANCHORS = ("outlook", "fiscal", "policy", "report", "risks", "economy", "reform", "gdp", "debt", "growth", "inflation", "sector")

# Sentences that are never relevant.
RELEVANT_REJECT = (r"^\d+\s", r"^This box", r"^Box \d+", r"^See ", r"\bauthors?\b", r"\bdataset\b", r"\bmethodology\b", r"\boutlined in\b")

# Intents in order of match.
INTENTS = (
    ("TABLE_LOOKUP", (r"table\s*\d+", r"(show|display|get)\s+(me\s+)?table", r"(data|info|information)\s+(from|in)\s+table")),
    ("POLICY_QUESTION", (
        r"\b(recommend|recommendation|recommendations|policy|policies)\b", r"\b(should|advised|stance|position)\b",
        r"(authorities|staff|imf).*(view|opinion|assess|recommend)", r"what (should|must|needs to)")),
    ("NUMERIC_LOOKUP", (
        r"(what|how).*(rate|growth|balance|deficit|surplus|gdp|inflation|percent|%).*\b(20\d{2})\b",
        r"\b(20\d{2})\b.*(what|how).*(rate|growth|balance|deficit|surplus|gdp|inflation|percent|%)",
        r"how (much|many).*(percent|%|billion|million|rate)", r"what (is|was|are|were) (the|qatar'?s?)\s+\w+.*(rate|growth|%|percent).*\b(20\d{2})\b")),
    ("TEXT_SUMMARY", (
        r"\b(explain|describe|summarize|outline)\b", r"\b(summary|overview|synopsis)\b", r"tell me (about|regarding)",
        r"(main|key|overall)\s+(points|findings|conclusions|takeaways)")),
)

# Modality of a question in order of match, and section words in order.
QUERY_MODALITIES = (
    ("TABLE", (r"\btable\b", r"\btables\b", r"\bdata\b.*\bshows?\b")),
    ("FIGURE", (r"\bfigure\b", r"\bfigures?\b", r"\bchart\b", r"\bgraph\b", r"\bvisual\b")),
    ("FOOTNOTE", (r"\bfootnote\b", r"\bnote\b.*\bmean")),
)
SECTION_WORDS = ("fiscal", "monetary", "economic", "outlook", "context", "external", "financial", "annex", "appendix", "staff")

# Allowed modalities in order of preference, and how many chunks a rule looks at.
GUARDRAILS = {
    "NUMERIC_LOOKUP": (("TABLE", "TEXT"), 3),
    "TABLE_LOOKUP": (("TABLE",), 1_000_000),
    "TEXT_SUMMARY": (("TEXT",), 15),
    "POLICY_QUESTION": (("TEXT",), 7),
    "UNKNOWN": (("TEXT", "TABLE", "FIGURE", "FOOTNOTE"), 1),
}

# Sections by page.
SECTION_PAGES = ((3, "Front Matter"), (6, "Press Release"), (35, "Staff Report"), (50, "Statistical Appendix"), (None, "Annexes"))
