"""Answers by rules, with citations, and by injected language models.

The input is ranked chunks: (query_id, chunk_id, rank, content, modality, page_number,
section_path, table_id, figure_id). Questions and ranked chunks are small; each rule
scans the first few chunks of its question and takes the first that succeeds as a
minimum by rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import tables as X
from ..functions import text as T

CITATION = "struct<citation_id:string,chunk_id:string,page_number:int,modality:string,section_path:string,table_id:string,figure_id:string,quoted_text:string>"
#: Columns of an answer besides query_id, query and intent.
FIELDS = "answer_text string, answer_type string, confidence string, citations array<struct>, sources_used int, sources_available int"

# What guards say, and why a rule finds nothing.
NO_CHUNKS = "No relevant documents retrieved."
NO_ALLOWED = "No chunks match allowed modalities."
WHICH_TABLE = "Multiple tables detected. Please specify a table number (e.g., 'Show me Table 1')."
WHICH_SUMMARY = "Please specify what you want summarized (for example, “Summarize the economic outlook”)."
REASONS = {
    "NUMERIC_LOOKUP": "No matching numeric value found.",
    "TABLE_LOOKUP": "No table number specified.",
    "TEXT_SUMMARY": "Insufficient summary-quality content found.",
    "POLICY_QUESTION": "No policy recommendation found.",
    "UNKNOWN": "The retrieved documents do not contain information related to this topic.",
}


def _allowed() -> Column:
    """Modalities of each intent in order of preference."""
    return F.create_map(*(x for k, (ms, _) in L.GUARDRAILS.items() for x in (F.lit(k), F.array(*(F.lit(m) for m in ms)))))


def guard(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """Chunks of modalities that the intent allows, by preference and then rank; ``pos`` counts from 1."""
    allowed = _allowed()
    window = F.create_map(*(x for k, (_, n) in L.GUARDRAILS.items() for x in (F.lit(k), F.lit(n))))
    q = queries.select("query_id", "query", T.intent(F.col("query")).alias("intent"))
    c = ranked.join(q, "query_id").withColumn("preference", F.array_position(allowed[F.col("intent")], F.col("modality")))
    kept = c.filter(F.col("preference") > 0)
    kept = kept.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("preference", "rank")))
    return kept.withColumn("available", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).withColumn("window", window[F.col("intent")])


def _cite(quote: Column, length: int, modality: Column | None = None, table_id: Column | None = None) -> Column:
    return F.array(
        F.struct(
            F.lit("[1]").alias("citation_id"),
            "chunk_id",
            F.col("page_number").cast("int").alias("page_number"),
            (F.col("modality") if modality is None else modality).alias("modality"),
            "section_path",
            (F.col("table_id") if table_id is None else table_id).alias("table_id"),
            "figure_id",
            F.substring(quote, 1, length).alias("quoted_text"),
        )
    ).cast(f"array<{CITATION}>")


def _first(found: DataFrame, text: Column, confidence: str, citations: Column, order: Column, kind: str = "DIRECT") -> DataFrame:
    row = F.struct(text.alias("answer_text"), F.lit(kind).alias("answer_type"), F.lit(confidence).alias("confidence"), citations.alias("citations"), F.lit(1).alias("sources_used"), F.col("available").cast("int").alias("sources_available"))
    return found.groupBy("query_id").agg(F.min_by(row, order).alias("r")).select("query_id", "r.*")


def numeric_answers(guarded: DataFrame, parity: bool = True) -> DataFrame:
    """A value from a table among the first 3 chunks, else from table-like text among the first 6."""
    n = guarded.filter("intent = 'NUMERIC_LOOKUP'").withColumn("year", T.target_year(F.col("query"))).withColumn("words", T.keywords(F.col("query"), years=False))
    in_table = F.when((F.col("modality") == "TABLE") & (F.col("pos") <= 3), X.markdown_lookup(F.col("content"), F.col("year"), F.col("words"), parity))
    in_text = F.when((F.col("modality") == "TEXT") & (F.col("pos") <= 6), X.text_table_lookup(F.col("content"), F.col("year"), F.col("words")))
    found = n.withColumn("phase", F.when(in_table.isNotNull(), 1).otherwise(2)).withColumn("hit", F.coalesce(in_table, in_text)).filter("hit is not null")
    text = F.concat("hit.label", F.lit(" is "), "hit.value", F.lit(" [1]."))
    quote = F.when(F.col("phase") == 1, F.concat_ws(" | ", "hit.label", "year", "hit.value")).otherwise(F.concat_ws(" ", "hit.label", "year", "hit.value"))
    out = _first(found, text, "HIGH", _cite(quote, 500), F.struct("phase", "pos"))
    return out.withColumn("confidence", F.when(F.col("citations")[0]["modality"] == "TABLE", "HIGH").otherwise("MEDIUM"))


def table_answers(guarded: DataFrame, parity: bool = False) -> DataFrame:
    """The first chunk of the table that is asked for. With ``parity`` Table 1 is also found in "Table 10"."""
    number = F.nullif(F.regexp_extract(F.lower("query"), r"table\s*(\d+)", 1), F.lit(""))
    t = guarded.filter("intent = 'TABLE_LOOKUP'").withColumn("number", number).filter("number is not null")
    name, low, ident = F.concat(F.lit("table "), "number"), F.lower("content"), F.lower(F.coalesce("table_id", F.lit("")))
    by_id = F.contains(ident, name) if parity else F.regexp_like(ident, F.concat(F.lit(r"\btable\s+"), "number", F.lit(r"[a-z]?\b")))
    in_text = F.contains(low, F.concat(name, F.lit("."))) | F.contains(low, F.concat(name, F.lit(":"))) | F.contains(low, F.concat(name, F.lit(" ")))
    starts = F.startswith(F.trim(low), name) if parity else F.regexp_like(F.trim(low), F.concat(F.lit("^"), name, F.lit(r"(?!\d)")))
    first = F.array_join(F.slice(F.split("content", "\n"), 1, 15), "\n")
    body = X.let(X.display_table(F.col("content")), lambda shown: F.when(shown == F.col("content"), first).otherwise(shown))
    title = F.when(F.coalesce("table_id", F.lit("")) != "", F.col("table_id")).otherwise(F.concat(F.lit("Table "), "number"))
    text = F.concat(title, F.lit(" (Page "), F.col("page_number").cast("string"), F.lit("):\n\n"), body, F.lit("\n\n[1]"))
    return _first(t.filter(by_id | in_text | starts), text, "HIGH", _cite(F.col("content"), 100, table_id=title), F.col("pos"))


def policy_answers(guarded: DataFrame) -> DataFrame:
    """The first policy sentence of the first 7 chunks."""
    p = guarded.filter("intent = 'POLICY_QUESTION' and pos <= window").select("*", F.posexplode(T.sentences(F.col("content"))).alias("at", "sentence"))
    found = p.filter(T.is_policy(F.col("sentence")))
    return _first(found, F.concat("sentence", F.lit(" [1]")), "HIGH", _cite(F.col("sentence"), 80, F.lit("TEXT")), F.struct("pos", "at"))


def summary_candidates(guarded: DataFrame) -> DataFrame:
    """Sentences of the first 15 text chunks that are worth a summary and hold a word of the question."""
    s = guarded.filter("intent = 'TEXT_SUMMARY' and modality = 'TEXT' and pos <= window").select("*", F.posexplode(T.sentences(F.col("content"))).alias("at", "sentence"))
    low = F.lower("sentence")
    relevant = F.exists(T.keywords(F.col("query")), lambda k: F.contains(low, k))
    section = F.coalesce("section_path", F.lit(""))
    return s.filter((F.length("sentence") >= 30) & relevant & T.summary_worthy(F.col("sentence"), section)).withColumn("score", T.summary_score(F.col("sentence"), section))


def summary_answers(guarded: DataFrame, most: int = 3, least: int = 2) -> DataFrame:
    """The best sentences, one a page, none alike: a fold over a question's candidates in order of score."""
    c = summary_candidates(guarded)
    item = F.struct((-F.col("score")).alias("k"), F.col("page_number").cast("int").alias("page"), "pos", "at", F.col("sentence").alias("text"), "chunk_id", "section_path")
    kind = "array<struct<k:int,page:int,pos:int,at:int,text:string,chunk_id:string,section_path:string>>"
    # A question has at most 15 chunks here, so its candidates are few.
    groups = c.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).cast(kind).alias("c"), F.max("available").alias("available"))

    def step(acc: Column, x: Column) -> Column:
        taken = F.exists(acc, lambda y: (y["page"] == x["page"]) | (T.token_overlap(x["text"], y["text"]) > 0.6))
        return F.when((F.size(acc) < most) & ~taken, F.concat(acc, F.array(x))).otherwise(acc)

    chosen = groups.withColumn("s", F.aggregate("c", F.array().cast(kind), step)).filter(F.size("s") >= least)
    # One marker for each chunk, by first appearance.
    ids = F.array_distinct(F.transform("s", lambda x: x["chunk_id"]))
    chosen = chosen.withColumn("ids", ids)
    mark = lambda x: F.concat(F.lit("["), F.array_position("ids", x["chunk_id"]).cast("string"), F.lit("]"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(" ", x["text"], mark(x))), " ")
    nothing = F.lit(None).cast("string")
    cites = F.transform(
        "ids",
        lambda i, k: F.struct(
            F.concat(F.lit("["), (k + 1).cast("string"), F.lit("]")).alias("citation_id"),
            i.alias("chunk_id"),
            F.filter("s", lambda x: x["chunk_id"] == i)[0]["page"].alias("page_number"),
            F.lit("TEXT").alias("modality"),
            F.filter("s", lambda x: x["chunk_id"] == i)[0]["section_path"].alias("section_path"),
            nothing.alias("table_id"),
            nothing.alias("figure_id"),
            F.substring(F.filter("s", lambda x: x["chunk_id"] == i)[0]["text"], 1, 80).alias("quoted_text"),
        ),
    ).cast(f"array<{CITATION}>")
    return chosen.select("query_id", text.alias("answer_text"), F.lit("DIRECT").alias("answer_type"), F.lit("MEDIUM").alias("confidence"), cites.alias("citations"), F.size("ids").alias("sources_used"), F.col("available").cast("int").alias("sources_available"))


def fallback_answers(guarded: DataFrame) -> DataFrame:
    """For questions in the domain, the first sentence of the first chunk."""
    u = guarded.filter("intent = 'UNKNOWN' and pos = 1").filter(T.in_domain(F.col("query"))).withColumn("sentence", F.get(T.sentences(F.col("content")), 0)).filter("sentence is not null")
    return _first(u, F.concat(F.lit("Based on retrieved content: "), "sentence", F.lit(" [1]")), "LOW", _cite(F.col("sentence"), 80), F.col("pos"), "PARTIAL")


def rule_answers(queries: DataFrame, ranked: DataFrame, parity: bool = False) -> DataFrame:
    """One answer for each question: guards first, then the rule of its intent, else a refusal."""
    guarded = guard(ranked, queries)
    found = numeric_answers(guarded).unionByName(table_answers(guarded, parity)).unionByName(policy_answers(guarded)).unionByName(summary_answers(guarded)).unionByName(fallback_answers(guarded))
    counts = ranked.join(queries.select("query_id", T.intent(F.col("query")).alias("_intent")), "query_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("retrieved"), F.count_if(F.array_contains(_allowed()[F.col("_intent")], F.col("modality"))).alias("usable"))
    q = queries.select("query_id", "query").withColumn("intent", T.intent(F.col("query")))
    out = q.join(found, "query_id", "left").join(counts, "query_id", "left")
    usable, number = F.coalesce("usable", F.lit(0)), F.nullif(F.regexp_extract(F.lower("query"), r"table\s*(\d+)", 1), F.lit(""))
    missing = F.when((F.col("intent") == "TABLE_LOOKUP") & number.isNotNull(), F.concat(F.lit("Table "), number, F.lit(" not found."))).otherwise(F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))[F.col("intent")])
    unknown = (F.col("intent") == "UNKNOWN") & ~T.in_domain(F.col("query"))
    # Guards in their order: no chunks, none of an allowed modality, tables in general, a summary of nothing in particular.
    guard_of = F.when(F.coalesce("retrieved", F.lit(0)) == 0, 1).when(usable == 0, 2).when(T.asks_for_tables(F.col("query")), 3).when((F.col("intent") == "TEXT_SUMMARY") & T.underspecified(F.col("query")), 4).otherwise(0)
    out = out.withColumn("guard", guard_of)
    ok = (F.col("guard") == 0) & F.col("answer_text").isNotNull()
    pick = lambda c, other: F.when(ok, F.col(c)).otherwise(other)
    refusal = lambda reason: F.concat(F.lit("I cannot answer this question. "), reason)
    said = F.when(F.col("guard") == 1, refusal(F.lit(NO_CHUNKS))).when(F.col("guard") == 2, refusal(F.lit(NO_ALLOWED))).when(F.col("guard") == 3, WHICH_TABLE).when(F.col("guard") == 4, WHICH_SUMMARY)
    seen = F.when(F.col("guard") == 3, F.col("retrieved")).when((F.col("guard") == 4) | ((F.col("guard") == 0) & unknown), usable).otherwise(0)
    return out.select(
        F.substring(F.sha2(F.concat_ws("|", "query_id", "query"), 256), 1, 8).alias("answer_id"),
        "query_id",
        "query",
        F.when(F.col("guard") == 3, "TABLE_LOOKUP").otherwise(F.col("intent")).alias("intent"),
        F.coalesce(said, F.when(ok, F.col("answer_text")), refusal(missing)).alias("answer_text"),
        pick("answer_type", F.lit("NOT_FOUND")).alias("answer_type"),
        pick("confidence", F.lit("NONE")).alias("confidence"),
        pick("citations", F.array().cast(f"array<{CITATION}>")).alias("citations"),
        pick("sources_used", F.lit(0)).alias("sources_used"),
        pick("sources_available", seen.cast("int")).alias("sources_available"),
    )


def citation_registry(cites: DataFrame) -> DataFrame:
    """(query_id, chunk_id, marker) from (query_id, pos, chunk_id): numbered by first appearance."""
    first = cites.groupBy("query_id", "chunk_id").agg(F.min("pos").alias("pos"))
    return first.select("query_id", "chunk_id", F.concat(F.lit("["), F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "chunk_id")).cast("string"), F.lit("]")).alias("marker"))


# --- language models --------------------------------------------------------

Model = Callable[[str], str]
REPLY = "answer string, cited_chunks array<int>, confidence string, reasoning string"


# How a prompt is put together.
QUESTION, INSTRUCTION = "\n\nQUESTION: ", "\n\nGenerate a grounded answer using ONLY the context above. Output valid JSON."


def prompts(queries: DataFrame, ranked: DataFrame, most: int = 10, chars: int = 2000, instruction: str = INSTRUCTION) -> DataFrame:
    """One prompt for each question, of its first chunks (numbered from 0), cut in length. A briefing differs by its instruction and ``most``."""
    head = F.concat(F.lit("[CHUNK "), (F.col("rank") - 1).cast("string"), F.lit("] (Page "), F.coalesce(F.col("page_number").cast("string"), F.lit("?")), F.lit(", "), "modality", F.lit(", "), F.coalesce("section_path", F.lit("")), F.lit(")"))
    few = ranked.filter(F.col("rank") <= most).withColumn("part", F.concat(head, F.lit("\n"), F.substring("content", 1, chars)))
    joined = few.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"]), "\n\n---\n\n").alias("context"), F.count(F.lit(1)).alias("n_chunks"))
    return queries.select("query_id", "query").join(joined, "query_id").select("query_id", "query", "n_chunks", F.concat(F.lit("CONTEXT:\n"), "context", F.lit(QUESTION), "query", F.lit(instruction)).alias("prompt"))


def parse_reply(raw: Column) -> Column:
    """the JSON from the first brace to the last, also inside a fence; else the text itself with low confidence."""
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    got = F.from_json(inner, REPLY)
    bare = F.struct(F.trim(F.regexp_replace(raw, r"```(?:json)?", "")).alias("answer"), F.array().cast("array<int>").alias("cited_chunks"), F.lit("low").alias("confidence"), F.lit(None).cast("string").alias("reasoning"))
    return F.when(raw.isNull(), F.lit(None)).when(got["answer"].isNotNull(), got).otherwise(bare)


def ask_model(prompted: DataFrame, model: Model, out: str = "reply") -> DataFrame:
    """The model's reply, or its error, for each prompt."""

    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for ps in batches:
            rows = []
            for p in ps:
                try:
                    rows.append((model(p), None))
                except Exception as e:  # an error is a result of its own: it decides on the next tier
                    rows.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["text", "error"])

    return prompted.withColumn(out, run("prompt"))


def model_answers(queries: DataFrame, ranked: DataFrame, models: list[Model], parity: bool = False) -> DataFrame:
    """Tiers of models, then the rules. A tier is passed over when it fails.

    With ``parity`` only failures that speak of quota pass on; others become the answer.
    """
    out = prompts(queries, ranked)
    text, quota = F.lit(None).cast("string"), r"(?i)429|quota|rate|exceeded"
    for k, model in enumerate(models):
        out = ask_model(out, model, f"_m{k}")
        error = F.when(parity & ~F.regexp_like(F.col(f"_m{k}.error"), F.lit(quota)), F.concat(F.lit("Error generating answer: "), f"_m{k}.error"))
        text = F.coalesce(text, F.col(f"_m{k}.text"), error)
    said = out.select("query_id", "n_chunks", parse_reply(text).alias("r")).filter("r is not null")
    refused = (F.coalesce("r.answer", F.lit("")) == "") | F.contains(F.lower("r.answer"), F.lit("do not contain"))
    cited = said.select("query_id", F.posexplode_outer("r.cited_chunks").alias("at", "chunk")).withColumn("rank", F.col("chunk") + 1).join(ranked.select("query_id", "rank", "chunk_id", "page_number", "modality", "section_path", "table_id", "figure_id", "content"), ["query_id", "rank"])
    one = F.struct("at", F.struct(F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")).alias("citation_id"), "chunk_id", F.col("page_number").cast("int").alias("page_number"), "modality", "section_path", "table_id", "figure_id", F.substring("content", 1, 100).alias("quoted_text")).cast(CITATION).alias("c"))
    cites = cited.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).alias("cites"))
    m = said.join(cites, "query_id", "left").select(
        "query_id",
        F.col("r.answer").alias("_text"),
        F.when(refused, "NOT_FOUND").when(F.size("cites") > 0, "DIRECT").otherwise("PARTIAL").alias("_type"),
        F.when(refused, "NONE").when(F.lower("r.confidence").isin("high", "low", "none"), F.upper("r.confidence")).otherwise("MEDIUM").alias("_conf"),
        F.coalesce("cites", F.array().cast(f"array<{CITATION}>")).alias("_cites"),
        F.col("n_chunks").cast("int").alias("_n"),
    )
    rules = rule_answers(queries, ranked, parity)
    both = rules.join(m, "query_id", "left")
    use = F.col("_type").isNotNull() & (F.col("_text") != "")
    swap = lambda a, b: F.when(use, b).otherwise(F.col(a)).alias(a)
    return both.select("answer_id", "query_id", "query", "intent", swap("answer_text", F.col("_text")), swap("answer_type", F.col("_type")), swap("confidence", F.col("_conf")), swap("citations", F.col("_cites")), swap("sources_used", F.size("_cites")), swap("sources_available", F.col("_n")))
