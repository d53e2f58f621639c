"""DuckDB SQL for the queries of ``catalog`` that SQL can express, written apart from the operators."""

from __future__ import annotations

from ..functions import lexicons as L
from ..operators.link import REFERENCES
from .fixtures import cte

SQL: dict[str, str] = {}

SECTION = "CASE WHEN {p} <= 3 THEN 'Front Matter' WHEN {p} <= 6 THEN 'Press Release' WHEN {p} <= 35 THEN 'Staff Report' WHEN {p} <= 50 THEN 'Statistical Appendix' ELSE 'Annexes' END"
HASH = r"sha256(trim(regexp_replace({t}, '\s+', ' ', 'g')))"
BLOCK_ID = r"format('{{}}_p{{:03d}}_{{}}_{{}}_{{:03d}}', {d}, {p}, lower({m}), substr(" + HASH + r", 1, 8), {o})"
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def matches(text: str, patterns, flags: str = "") -> str:
    return f"regexp_matches({text}, {q(flags + '|'.join(f'(?:{p})' for p in patterns))})"


def cases(text: str, families, flags: str = "", other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {matches(text, ps, flags)} THEN '{name}'" for name, ps in families) + f" ELSE {other} END"


#: Intents by patterns written out here, so that an error in the lists of the library shows.
INTENT = r"""CASE
    WHEN regexp_matches(lower(query), 'table\s*\d+|(show|display|get)\s+(me\s+)?table|(data|info|information)\s+(from|in)\s+table') THEN 'TABLE_LOOKUP'
    WHEN regexp_matches(lower(query), '\b(recommend|recommendation|recommendations|policy|policies)\b|\b(should|advised|stance|position)\b|(authorities|staff|imf).*(view|opinion|assess|recommend)|what (should|must|needs to)') THEN 'POLICY_QUESTION'
    WHEN regexp_matches(lower(query), '(what|how).*(rate|growth|balance|deficit|surplus|gdp|inflation|percent|%).*\b20\d{2}\b|\b20\d{2}\b.*(what|how).*(rate|growth|balance|deficit|surplus|gdp|inflation|percent|%)|how (much|many).*(percent|%|billion|million|rate)|what (is|was|are|were) (the|qatar''?s?)\s+\w+.*(rate|growth|%|percent).*\b20\d{2}\b') THEN 'NUMERIC_LOOKUP'
    WHEN regexp_matches(lower(query), '\b(explain|describe|summarize|outline)\b|\b(summary|overview|synopsis)\b|tell me (about|regarding)|(main|key|overall)\s+(points|findings|conclusions|takeaways)') THEN 'TEXT_SUMMARY'
    ELSE 'UNKNOWN' END"""


DOC_BLOCKS = f"""doc_blocks AS (
  SELECT source AS document_id, CASE WHEN contains(text, ' | ') THEN 'TABLE' ELSE 'TEXT' END AS modality, text AS content, (doc_id % 60 + 1)::INT AS page_number, doc_id AS ord, NULL AS figure_id FROM documents),
all_blocks AS (
  SELECT * FROM doc_blocks
  UNION ALL SELECT 'benchmark', 'FOOTNOTE', text, (item_id % 60 + 1)::INT, item_id, NULL FROM benchmark
  UNION ALL SELECT 'pages', 'FIGURE', trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), (page_id % 60 + 1)::INT, page_id, 'Figure ' || page_id FROM pages),
ix AS (SELECT *, document_id || '_' || ord AS chunk_id, lower(content) AS lc, {SECTION.format(p="page_number")} AS section FROM all_blocks)"""

STRUCTURE = r"""try_cast(nullif(regexp_extract(text, '^\s*(\d{1,3})\.\s+', 1), '') AS INT) AS paragraph"""
LEVEL = r"""CASE WHEN regexp_matches(trim(text), '(?i)^(?:CONTEXT|OUTLOOK|POLICIES|STAFF APPRAISAL|KEY ISSUES)') THEN 1
  WHEN regexp_matches(trim(text), '^[A-Z]\.\s+') THEN 2 WHEN regexp_matches(trim(text), '(?i)^Annex\s+[IVX]+') THEN 2
  WHEN regexp_matches(trim(text), '^\d{1,2}\.\s+[A-Z]') AND length(trim(text)) < 100 AND NOT ends_with(trim(text), '.') THEN 3 END"""
REFERS = r"regexp_matches(text, '(?i)\b(?:Table\s+\d+|Figure\s+\d+|Text\s+Figure\s+\d+|Box\s+\d+|Annex\s+[IVX]+)')"
_STRUCT = f"{{i}}, {STRUCTURE}, {LEVEL} AS level, CASE WHEN {LEVEL} IS NOT NULL THEN 'heading' WHEN regexp_matches(trim(text), '^[•●○\\-–—]') THEN 'bullet' ELSE 'body' END AS kind, {REFERS} AS refers"

SQL["block_identity"] = (
    "SELECT doc_id, lower(regexp_replace(source || ' v1', '[^\\pL\\pN]', '_', 'g')) AS document_id, " + HASH.format(t="text") + " AS content_hash, " + BLOCK_ID.format(d="source", p="(doc_id % 60 + 1)", m="'TEXT'", t="text", o="doc_id") + " AS block_id FROM documents"
)
SQL["whitespace_normalize"] = r"""
SELECT doc_id, md5(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '[\t\r\f\x0B]+', ' ', 'g'), ' +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda x: trim(x)), chr(10)), '^\s+|\s+$', '', 'g')) AS normal,
  md5(replace(replace(replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '([\pL\pN_])-\s*\n\s*([\pL\pN_])', '\1\2', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff')) AS clean FROM documents"""
SQL["text_structure"] = f"WITH {cte('texts')} SELECT {_STRUCT.replace('{i}', 'id')} FROM texts"
SQL["document_structure"] = f"SELECT {_STRUCT.replace('{i}', 'doc_id')} FROM documents"
SQL["header_footer_filter"] = f"""WITH {cte('page_items')} SELECT id, text FROM page_items WHERE NOT (y / height < 0.05 OR y / height > 0.95 OR regexp_matches(trim(text), '(?i)^INTERNATIONAL MONETARY FUND$|^QATAR$|^\\d{{1,3}}$|^IMF Country Report'))"""
SQL["section_citations"] = f"""
WITH {DOC_BLOCKS}, s AS (SELECT *, {SECTION.format(p="page_number")} AS section FROM doc_blocks)
SELECT ord, section, 'Policies > Risks' AS path, CASE WHEN modality = 'TABLE' THEN '[Table, Page ' ELSE '[Page ' END || page_number || ']' AS citation_short,
 CASE WHEN modality = 'TABLE' THEN '[Table, Page ' ELSE '[' || section || ', Page ' END || page_number || ']' AS citation_section, CASE WHEN modality = 'TABLE' THEN 'Table: , Page ' ELSE section || ', Page ' END || page_number AS citation_full FROM s"""
SQL["sentence_stats"] = f"SELECT doc_id, len({SENTENCES.format(t='text')}) AS n, coalesce(list_sum(list_transform({SENTENCES.format(t='text')}, lambda s: length(s))), 0)::INT AS chars FROM documents"
SQL["manifest"] = f"""
WITH {DOC_BLOCKS} SELECT document_id, count(*) AS total_block_count, {", ".join(f"count(*) FILTER (modality = '{m}') AS {m.lower()}_count" for m in L.MODALITIES)},
 1.0::DOUBLE AS average_confidence, 0 AS low_confidence_count, count(DISTINCT page_number) AS pages_with_blocks FROM all_blocks GROUP BY document_id"""
SQL["modality_histogram"] = f"WITH {DOC_BLOCKS} SELECT modality, count(*) AS chunks FROM all_blocks GROUP BY modality"
SQL["valid_documents"] = f"""
WITH {DOC_BLOCKS} SELECT modality, count(*) AS blocks, count(*) FILTER (NOT (modality = 'TEXT' AND content = '')) AS valid,
 sum(CASE WHEN modality = 'TEXT' THEN 1 + (content = '')::INT WHEN modality = 'TABLE' THEN 1 WHEN modality = 'FIGURE' THEN 1 ELSE 0 END)::BIGINT AS issues FROM all_blocks GROUP BY modality"""
SQL["validate_blocks"] = f"""
WITH {cte('checked')}, r AS (SELECT *, coalesce(nullif(block_id, ''), '<no_id>') AS b FROM checked)
SELECT b AS block_id, 'block_id' AS field, 'required field is empty' AS message, 'error' AS severity FROM r WHERE coalesce(block_id, '') = ''
UNION ALL SELECT b, 'document_id', 'required field is empty', 'error' FROM r WHERE coalesce(document_id, '') = ''
UNION ALL SELECT b, 'modality', 'invalid modality', 'error' FROM r WHERE modality NOT IN ({", ".join(map(q, L.MODALITIES))})
UNION ALL SELECT b, 'page_number', 'required field is missing', 'error' FROM r WHERE page_number IS NULL
UNION ALL SELECT b, 'page_number', 'must be 1 or more', 'error' FROM r WHERE page_number < 1
UNION ALL SELECT b, 'content', 'text blocks need content', 'error' FROM r WHERE modality = 'TEXT' AND content = ''
UNION ALL SELECT b, 'extraction_confidence', 'must be from 0 to 1', 'warning' FROM r WHERE confidence NOT BETWEEN 0 AND 1
UNION ALL SELECT b, 'content_length', 'differs from the content''s length', 'warning' FROM r WHERE content <> '' AND content_length <> length(content)
UNION ALL SELECT b, 'section_hierarchy', 'must not be empty', 'error' FROM r WHERE sections IS NULL
UNION ALL SELECT b, 'bounding_box.x', 'invalid x coordinates', 'warning' FROM r WHERE x0 IS NOT NULL AND NOT (x0 >= 0 AND x0 <= x1 AND x1 <= 1)
UNION ALL SELECT b, 'text_metadata', 'text blocks should have text metadata', 'warning' FROM r WHERE modality = 'TEXT'
UNION ALL SELECT b, 'table_metadata', 'table blocks should have table metadata', 'warning' FROM r WHERE modality = 'TABLE'
UNION ALL SELECT b, 'citation_short', 'citations should be filled', 'warning' FROM r WHERE short = ''"""
SQL["embedding_input"] = f"""WITH {DOC_BLOCKS} SELECT ord, md5('[' || modality || '] ' || {SECTION.format(p="page_number")} || chr(10) || chr(10) || content) AS input FROM doc_blocks"""
_RAW = "list_transform(range(0, 32), lambda i: ('0x' || substr({h}, (i * 2 + 1)::INT, 2))::INT / 127.5::DOUBLE - 1.0::DOUBLE)"
SQL["mock_embedding"] = rf"""
WITH h AS (SELECT doc_id, sha256(CASE WHEN regexp_replace(text, '^\s+|\s+$', '', 'g') = '' THEN '__EMPTY_CHUNK_PLACEHOLDER__' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END) AS h FROM documents),
r AS (SELECT doc_id, {_RAW.format(h="h")} AS r FROM h), n AS (SELECT *, sqrt(12 * list_sum(list_transform(r, lambda x: x * x))) AS n FROM r)
SELECT doc_id, 384 AS dim, round(r[1] / n, 6) AS v0, round(r[32] / n, 6) AS v31, round(r[1] / n, 6) AS v32, round(r[32] / n, 6) AS v383, 1.0::DOUBLE AS norm FROM n"""
_NORM = "sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"
SQL["vector_health"] = f"""SELECT vec_id, round({_NORM.format(v="embedding")}, 4) AS norm, len(list_filter(embedding, lambda x: isnan(x))) > 0 AS has_nan, len(list_filter(embedding, lambda x: x <> 0)) = 0 AS is_zero, abs({_NORM.format(v="embedding")} - 1) <= 0.01 AS is_unit FROM embeddings"""
SQL["index_metadata"] = f"""WITH {DOC_BLOCKS} SELECT chunk_id, {BLOCK_ID.format(d="document_id", p="page_number", m="modality", t="content", o="ord")} AS parent_block_id, document_id, modality, page_number, section AS section_path, section AS section_level_0, '' AS section_level_1, '' AS table_id, coalesce(figure_id, '') AS figure_id, 0 AS chunk_index, 1 AS total_chunks, 1.0::DOUBLE AS extraction_confidence FROM ix"""
SQL["duplicate_check"] = "SELECT count(*) AS total, count(DISTINCT md5(text)) AS unique_ids, count(text) - count(DISTINCT md5(text)) AS duplicates FROM documents"
SQL["dimension_check"] = f"""
WITH d AS (SELECT count(DISTINCT len(embedding)) AS dims, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM embeddings),
n AS (SELECT {_NORM.format(v="embedding")} AS n FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 100))
SELECT d.*, round(min(n), 4) AS min_norm, round(max(n), 4) AS max_norm, round(avg(n), 4) AS avg_norm, count(n) AS sampled FROM d, n GROUP BY ALL"""
SQL["metadata_nulls"] = f"""WITH {DOC_BLOCKS} SELECT 'chunk_id' AS field, 0 AS missing UNION ALL SELECT 'modality', 0 UNION ALL SELECT 'page_number', 0 UNION ALL SELECT 'table_id', count(*) FROM ix UNION ALL SELECT 'figure_id', count(*) FILTER (figure_id IS NULL) FROM ix"""
SQL["section_coverage"] = f"WITH {DOC_BLOCKS} SELECT count(DISTINCT section) AS sections FROM ix"
_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_COS = f"{_DOT} / ({_NORM.format(v='{a}')} * {_NORM.format(v='{b}')})"
SQL["self_similarity"] = f"""
WITH s AS (SELECT vec_id AS query_id, embedding AS x FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 10),
c AS (SELECT query_id, vec_id, round({_COS.format(a="x", b="embedding")}, 6) AS score FROM s, embeddings)
SELECT query_id, vec_id AS nearest_id, round(score, 4) AS score FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, (vec_id = query_id) DESC) = 1"""
SQL["cross_label_similarity"] = f"""
WITH f AS (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5)
SELECT a.label AS modality_a, b.label AS modality_b, count(*) AS pairs, round(avg({_COS.format(a="a.embedding", b="b.embedding")}), 4) AS similarity FROM f a, f b WHERE a.label < b.label GROUP BY ALL"""
_TOPK = """
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id::VARCHAR AS chunk_id, b.vec_id AS ord, {dot} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 {where})
SELECT query_id, chunk_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord, chunk_id) AS rank FROM s QUALIFY rank <= {k}"""
SQL["vector_topk_batch"] = _TOPK.format(dot=_DOT.format(a="a.embedding", b="b.embedding"), where="", k=10)
SQL["vector_topk_filtered"] = _TOPK.format(dot=_DOT.format(a="a.embedding", b="b.embedding"), where="AND a.label = b.label", k=5)
_WORDS = "list_filter(string_split_regex(replace(replace(query, '?', ''), '''s', ' '), '\\s+'), lambda t: t <> '')"
_DOMAIN = f"NOT {any_of('lower({t})', L.OUT_OF_DOMAIN)} AND {any_of('lower({t})', L.IN_DOMAIN)}"
_PARSED = f"""parsed AS (SELECT query_id, query, {cases("query", L.QUERY_MODALITIES, "(?i)")} AS expected_modality,
  'Table ' || nullif(regexp_extract(query, '(?i)\\btable\\s+(\\d+[a-z]?)', 1), '') AS q_table_id, 'Figure ' || nullif(regexp_extract(query, '(?i)\\bfigure\\s+(\\d+)', 1), '') AS q_figure_id,
  try_cast(nullif(regexp_extract(query, '(?i)\\bpage\\s+(\\d+)', 1), '') AS INT) AS q_page,
  CASE {" ".join(f"WHEN contains(lower(query), '{w}') THEN '{w.title()}'" for w in L.SECTION_WORDS)} END AS section_hint,
  {INTENT} AS intent, {_DOMAIN.format(t="query")} AS in_domain FROM questions)"""
SQL["parse_queries"] = f"WITH {cte('questions')}, {_PARSED} SELECT * EXCLUDE (query) FROM parsed"
SQL["query_guards"] = f"""
WITH {cte('questions')}, w AS (SELECT *, {_WORDS} AS w FROM questions), l AS (SELECT *, list_transform(w, lambda t: lower(t)) AS l FROM w)
SELECT query_id, regexp_matches(lower(query), '\\btables\\b') AS tables, (len(l) <= 2 OR len(list_filter(l, lambda t: t NOT IN ({", ".join(map(q, L.GENERIC_WORDS))}))) = 0) AND NOT {any_of("lower(query)", L.ANCHORS)} AS underspecified,
 list_filter(w, lambda t: regexp_matches(t, '^20\\d{{2}}'))[1] AS year, array_to_string(list_filter(l, lambda t: length(t) > 2 AND NOT regexp_matches(t, '^20\\d{{2}}')), ',') AS keywords FROM l"""
SQL["benchmark_intents"] = f"""SELECT item_id, {INTENT.replace("lower(query)", "lower(text)")} AS intent, {_DOMAIN.format(t="text")} AS in_domain FROM benchmark"""
_KEYWORD = """hits AS (SELECT query_id, chunk_id, ord, len(list_filter(list_distinct(list_filter(string_split_regex(lower(query), '\\s+'), lambda t: t <> '')), lambda t: contains(lc, t))) AS hits FROM questions, ix),
kw AS (SELECT query_id, chunk_id, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, ord, chunk_id) AS rank FROM hits WHERE hits > 0 QUALIFY rank <= {k})"""
SQL["keyword_topk"] = f"WITH {cte('questions')}, {DOC_BLOCKS}, {_KEYWORD.format(k=8)} SELECT * FROM kw"
_PROTECT = """first AS (SELECT chunk_id, ord, modality, row_number() OVER (PARTITION BY modality ORDER BY ord, chunk_id) AS place FROM ix QUALIFY place <= {n}),
asks AS (SELECT query_id, 0 AS part, expected_modality AS modality, {n} AS most FROM parsed WHERE expected_modality IS NOT NULL
  UNION ALL SELECT query_id, part, modality, greatest({n} // 2, 1) FROM parsed, (VALUES (0, 'TABLE'), (1, 'FIGURE')) AS m(part, modality) WHERE expected_modality IS NULL),
protect AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY part, place) AS rank FROM first JOIN asks USING (modality) WHERE place <= most)"""
SQL["modality_protect"] = f"WITH {cte('questions')}, {DOC_BLOCKS}, {_PARSED}, {_PROTECT.format(n=5)} SELECT * FROM protect"
# The 384 numbers repeat 32 of them twelve times: the dot product is that of the 32 at unit length.
_MOCK = rf"""hq AS (SELECT query_id, sha256(trim(query)) AS h FROM questions), rq AS (SELECT query_id, {_RAW.format(h="h")} AS r FROM hq), vq AS (SELECT query_id, r, {_NORM.format(v="r")} AS n FROM rq),
hx AS (SELECT *, sha256(CASE WHEN regexp_replace(content, '^\s+|\s+$', '', 'g') = '' THEN '__EMPTY_CHUNK_PLACEHOLDER__' ELSE regexp_replace(content, '^\s+|\s+$', '', 'g') END) AS h FROM ix), rx AS (SELECT *, {_RAW.format(h="h")} AS r FROM hx), vx AS (SELECT *, {_NORM.format(v="r")} AS n FROM rx),
near AS (SELECT p.query_id, x.chunk_id, x.ord, {_DOT.format(a="vq.r", b="x.r")} / (vq.n * x.n) AS score FROM parsed p JOIN vq USING (query_id), vx x
  WHERE (q_table_id IS NULL OR q_table_id = '') AND (q_figure_id IS NULL OR q_figure_id = coalesce(x.figure_id, '')) AND (q_page IS NULL OR q_page = x.page_number)),
vec AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord, chunk_id) AS rank FROM near QUALIFY rank <= {{wide}}),
lists AS (SELECT query_id, chunk_id, 0 AS l, rank FROM vec UNION ALL SELECT query_id, chunk_id, 1, rank FROM kw UNION ALL SELECT query_id, chunk_id, 2, rank FROM protect),
fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(l * 1000000 + rank) AS first FROM lists GROUP BY ALL),
hybrid AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS rank FROM fused QUALIFY rank <= {{wide}})"""


def _hybrid(k: int) -> str:
    return f"WITH {cte('questions')}, {DOC_BLOCKS}, {_PARSED}, {_KEYWORD.format(k=5 * k // 2)}, {_PROTECT.format(n=k)}, {_MOCK.format(wide=5 * k)}"


SQL["hybrid_retrieve"] = f"{_hybrid(5)} SELECT query_id, chunk_id, rank, round(score, 6) AS score, modality, page_number FROM hybrid JOIN ix USING (chunk_id) WHERE rank <= 5"
_BOOST = """CASE WHEN expected_modality IS NULL THEN 0.0 WHEN expected_modality = modality THEN 0.1 ELSE -0.05 END::DOUBLE AS b_mod, CASE WHEN q_figure_id = figure_id THEN 0.3 ELSE 0.0 END::DOUBLE AS b_fig, CASE WHEN contains(lower(section), lower(section_hint)) THEN 0.05 ELSE 0.0 END::DOUBLE AS b_sec"""
SQL["rerank_fused"] = f"""{_hybrid(5)}, b AS (SELECT hybrid.*, {_BOOST} FROM hybrid JOIN ix USING (chunk_id) JOIN parsed USING (query_id)),
t AS (SELECT *, round(score + b_mod + b_fig + b_sec + 0.02::DOUBLE + 0.02::DOUBLE, 12) AS total FROM b)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, t.rank) AS rank, round(total, 6) AS score,
 array_to_string(list_filter(['complete', 'confidence', CASE WHEN b_fig <> 0 THEN 'figure_id' END, CASE WHEN b_mod <> 0 THEN 'modality' END, CASE WHEN b_sec <> 0 THEN 'section' END], lambda x: x IS NOT NULL), ',') AS signals FROM t QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY total DESC, t.rank) <= 5"""
_UNIQUE = "list_distinct(regexp_extract_all(lower({t}), '[\\pL\\pN_]+'))"
_RERANK = f"""{_hybrid(4)}, b AS (SELECT hybrid.*, {_BOOST}, len(list_intersect({_UNIQUE.format(t="query")}, {_UNIQUE.format(t="content")})) / len({_UNIQUE.format(t="query")})::DOUBLE * 0.1 AS terms, length(content) AS size FROM hybrid JOIN ix USING (chunk_id) JOIN parsed USING (query_id)),
f AS (SELECT *, round(score + round(terms, 12) + b_mod + b_fig + b_sec + 0.04::DOUBLE + CASE WHEN size < 100 OR size > 2000 THEN -0.01 ELSE 0.0 END::DOUBLE, 12) AS final_score FROM b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 10) DESC, rank) AS final_rank FROM f)"""
SQL["full_rerank"] = f"{_RERANK} SELECT query_id, chunk_id, rank, final_rank, round(final_score, 6) AS final_score, round(terms, 6) AS term_overlap, rank - final_rank AS rank_change FROM ranked"
SQL["rank_movers"] = f"""{_RERANK}, m AS (SELECT *, rank - final_rank AS rank_change, row_number() OVER (PARTITION BY query_id ORDER BY abs(rank - final_rank) DESC, final_rank) AS m FROM ranked)
SELECT query_id, 'before' AS part, rank AS place, chunk_id, round(score, 6) AS score, rank_change FROM m WHERE rank <= 5 UNION ALL SELECT query_id, 'after', final_rank, chunk_id, round(final_score, 6), rank_change FROM m WHERE final_rank <= 5 UNION ALL SELECT query_id, 'movers', m, chunk_id, round(final_score, 6), rank_change FROM m WHERE m <= 3"""
SQL["verify_rank"] = f"{_hybrid(10)} SELECT query_id, min(rank) FILTER (page_number = 39) AS best_rank, coalesce(min(rank) FILTER (page_number = 39) <= 5, false) AS passed FROM hybrid JOIN ix USING (chunk_id) WHERE rank <= 10 GROUP BY query_id"

_REFS = " UNION ALL ".join(f"SELECT block_id AS source, '{kind}' AS ref_type, unnest(regexp_extract_all(content, {q(p)}, 1)) AS reference_text, {'upper' if up else ''}(unnest(regexp_extract_all(content, {q(p)}, 2))) AS ref_id FROM linkable WHERE modality = 'TEXT'" for kind, p, up in REFERENCES)
_LINK = f"""WITH {cte('linkable')}, refs AS ({_REFS}),
targets AS (
  SELECT 'TABLE' AS ref_type, regexp_extract(table_id, '(?i)Table\\s+(\\d+[a-z]?)', 1) AS ref_id, block_id, ord FROM linkable WHERE table_id IS NOT NULL
  UNION ALL SELECT 'TEXT_FIGURE', regexp_extract(figure_id, '(?i)Text\\s+Figure\\s+(\\d+)', 1), block_id, ord FROM linkable WHERE figure_id IS NOT NULL
  UNION ALL SELECT 'FIGURE', regexp_extract(figure_id, '(?i)^Figure\\s+(\\d+)', 1), block_id, ord FROM linkable WHERE figure_id IS NOT NULL
  UNION ALL SELECT 'ANNEX', upper(coalesce(nullif(regexp_extract(substr(content, 1, 200), '(?i)Annex\\s+([IVX]+)', 1), ''), regexp_extract(section, '(?i)Annex\\s+([IVX]+)', 1))), block_id, ord FROM linkable WHERE modality NOT IN ('TABLE', 'FIGURE') AND (contains(lower(substr(content, 1, 100)), 'annex') OR contains(lower(section), 'annex'))
  UNION ALL SELECT 'BOX', regexp_extract(substr(content, 1, 100), '(?i)Box\\s+(\\d+)', 1), block_id, ord FROM linkable WHERE contains(lower(substr(content, 1, 50)), 'box')),
last AS (SELECT ref_type, ref_id, max_by(block_id, ord) AS target FROM targets WHERE ref_id <> '' GROUP BY ALL),
j AS (SELECT * FROM refs LEFT JOIN last USING (ref_type, ref_id))"""
SQL["crossref_link"] = f"{_LINK} SELECT source AS source_block_id, target AS target_block_id, reference_text FROM j WHERE target <> source"
SQL["crossref_unresolved"] = f"{_LINK} SELECT source AS source_block_id, ref_type, ref_id, reference_text FROM j WHERE target IS NULL OR target = source"
_NOTES = f"""WITH {cte('linkable')}, marks AS (SELECT block_id, modality, page_number, regexp_extract_all(content, '(\\d+/)', 1) AS ms FROM linkable WHERE modality <> 'FOOTNOTE'),
m AS (SELECT block_id, modality, page_number, unnest(ms) AS marker, unnest(range(0, len(ms))) AS position FROM marks),
f AS (SELECT rtrim(marker, '/') AS norm, page_number AS note_page, max_by(block_id, ord) AS target, min(ord) AS first_ord FROM linkable WHERE modality = 'FOOTNOTE' GROUP BY ALL),
near AS (SELECT m.*, target, CASE note_page - page_number WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN -1 THEN 2 WHEN 2 THEN 3 WHEN -2 THEN 4 ELSE 5 END AS choice, first_ord FROM m LEFT JOIN f ON rtrim(m.marker, '/') = f.norm),
best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY block_id, position ORDER BY choice, first_ord) = 1)"""
SQL["footnote_nearest"] = f"{_NOTES} SELECT block_id AS source_block_id, position, marker, target AS target_block_id FROM best"
SQL["footnote_orphans"] = f"{_NOTES} SELECT block_id, marker, page_number FROM linkable WHERE modality = 'FOOTNOTE' AND block_id NOT IN (SELECT target FROM best WHERE target IS NOT NULL)"
SQL["marker_orphans"] = f"{_NOTES} SELECT block_id AS source_block_id, marker, page_number FROM best WHERE target IS NULL AND length(rtrim(marker, '/')) <= 2 AND modality IN ('TEXT', 'TABLE')"
SQL["relationship_integrity"] = f"""WITH {cte('edges')}, {cte('linkable')}
SELECT relationship_id, 'relationship_id' AS field, 'required field is empty' AS message FROM edges WHERE coalesce(relationship_id, '') = ''
UNION ALL SELECT relationship_id, 'source_block_id', 'required field is empty' FROM edges WHERE coalesce(source_block_id, '') = ''
UNION ALL SELECT relationship_id, 'relationship_type', 'required field is empty' FROM edges WHERE coalesce(relationship_type, '') = ''
UNION ALL SELECT relationship_id, 'source_block_id', 'block not found' FROM edges WHERE source_block_id NOT IN (SELECT block_id FROM linkable)
UNION ALL SELECT relationship_id, 'target_block_id', 'block not found' FROM edges WHERE target_block_id NOT IN (SELECT block_id FROM linkable)
UNION ALL SELECT relationship_id, 'source_block_id/target_block_id', 'self-reference' FROM edges WHERE source_block_id = target_block_id"""
SQL["relationship_valid"] = f"WITH {cte('edges')}, {cte('linkable')} SELECT relationship_id, source_block_id, target_block_id FROM edges WHERE source_block_id <> target_block_id AND source_block_id IN (SELECT block_id FROM linkable) AND target_block_id IN (SELECT block_id FROM linkable)"
SQL["numeric_cell"] = f"""WITH {cte('cells')} SELECT id, regexp_matches(trim(regexp_replace(regexp_replace(trim(cell), '[,%$]', '', 'g'), '^\\((.*)\\)$', '-\\1')), '^[+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?$') AS numeric, nullif(regexp_extract(cell, '\\s*(\\d+/)\\s*$', 1), '') AS marker FROM cells"""
SQL["table_shape"] = f"""WITH {cte('grids')}, n AS (SELECT *, coalesce(regexp_matches(trim(regexp_replace(cell, '[,%$]', '', 'g')), '^[+-]?(?:\\d+\\.?\\d*)$'), false) AS num FROM grids),
rows AS (SELECT id, r, count(*) AS c, count(*) FILTER (num) > count(*) / 2 AS mostly FROM n GROUP BY ALL),
h AS (SELECT id, max(c) AS columns, count(*) AS row_count, coalesce(greatest(min(r) FILTER (mostly), 1), 1) AS h FROM rows GROUP BY id)
SELECT h.id, h AS header_rows, row_count - h AS data_rows, columns, row_count, (SELECT count(*) FROM grids g WHERE g.id = h.id AND g.r >= h AND cell IS NULL) > 0 AS merged,
 coalesce((SELECT string_agg(DISTINCT m, ',' ORDER BY m) FROM (SELECT unnest(regexp_extract_all(cell, '(\\d+/|\\*+)', 1)) AS m FROM grids g WHERE g.id = h.id)), '') AS refs FROM h"""
SQL["table_markdown"] = f"""WITH {cte('grids')}, l AS (SELECT id, r, '| ' || string_agg(coalesce(cell, ''), ' | ' ORDER BY c) || ' |' AS md, string_agg(coalesce(cell, ''), chr(9) ORDER BY c) AS tsv, '|' || string_agg('---', '|') || '|' AS rule FROM grids GROUP BY ALL)
SELECT id, string_agg(CASE WHEN r = 0 THEN md || chr(10) || rule ELSE md END, chr(10) ORDER BY r) AS markdown, string_agg(tsv, chr(10) ORDER BY r) AS linear FROM l GROUP BY id"""
_MDROWS = "list_filter(list_transform(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '|-') AND contains(x, '|')), lambda x: list_filter(list_transform(string_split(x, '|'), lambda c: trim(c)), lambda c: c <> '')), lambda r: len(r) > 0)"
SQL["markdown_documents"] = f"WITH {DOC_BLOCKS}, r AS (SELECT ord, {_MDROWS} AS rows FROM doc_blocks WHERE modality = 'TABLE') SELECT ord, len(rows) AS rows, coalesce(list_sum(list_transform(rows, lambda r: len(r))), 0)::INT AS cells FROM r"
SQL["text_table_detect"] = f"""WITH {cte('markdown')}, x AS (SELECT id, content, string_split(trim(content), chr(10)) AS ls FROM markdown), y AS (SELECT *, list_filter(list_transform(ls, lambda l: length(l)), lambda n: n > 10) AS ns FROM x),
p AS (SELECT id, (len(regexp_extract_all(content, '\\b20\\d{{2}}\\b')) >= 2)::INT + (len(list_filter(ls, lambda l: len(regexp_extract_all(l, '-?\\d+\\.?\\d*')) >= 2)) >= 2)::INT
 + (regexp_matches(content, '(?i)gdp|growth|inflation|deficit|surplus|export|import')::INT + regexp_matches(content, '(?i)revenue|expenditure|balance|account|reserve')::INT + regexp_matches(content, '(?i)rate|percent|ratio|index')::INT >= 2)::INT
 + coalesce(len(ls) >= 3 AND len(ns) > 0 AND len(list_filter(ns, lambda n: abs(n - list_avg(ns)) < list_avg(ns) * 0.5)) >= len(ns) * 0.5, false)::INT AS points FROM y)
SELECT id, points, points >= 2 AS is_table FROM p"""
_PROSE = f"WITH {cte('prose')}, x AS (SELECT *, {SENTENCES.format(t='content')} AS ss FROM prose), s AS (SELECT id, page_number, section, unnest(ss) AS sentence, unnest(range(0, len(ss))) AS at_ FROM x)"
SQL["summary_candidates"] = f"""{_PROSE} SELECT id::VARCHAR AS chunk_id, at_ AS "at", sentence,
 CASE WHEN {any_of("lower(sentence)", L.CAUSAL)} THEN 3 ELSE 0 END + CASE WHEN {any_of("lower(sentence)", L.MACRO)} THEN 2 ELSE 0 END + CASE WHEN {any_of("lower(section)", L.PREFERRED_SECTIONS)} THEN 1 ELSE 0 END - CASE WHEN contains(lower(section), 'press release') THEN 1 ELSE 0 END AS score
FROM s WHERE length(sentence) >= 30 AND {any_of("lower(sentence)", ("summarize", "the", "economic", "outlook"))} AND NOT regexp_matches(trim(sentence), '^[\\d•\\-*]') AND NOT {any_of("lower(sentence)", L.SUMMARY_REJECT)} AND NOT {any_of("lower(section)", ("appendix", "statistical", "annex"))}
 AND {any_of("lower(sentence)", L.CAUSAL)}::INT + {any_of("lower(sentence)", L.MACRO)}::INT + (len(list_filter(string_split_regex(sentence, '\\s+'), lambda w: w <> '')) >= 12)::INT >= 2"""
_POLICY = matches("lower(sentence)", L.POLICY_PATTERNS)
SQL["policy_sentence"] = f"""{_PROSE} SELECT 'q' AS query_id, sentence || ' [1]' AS answer_text, 'DIRECT' AS answer_type, 'HIGH' AS confidence, id::VARCHAR AS cited, substr(sentence, 1, 80) AS quote FROM s WHERE length(sentence) >= 20 AND {_POLICY} ORDER BY id, at_ LIMIT 1"""
SQL["policy_documents"] = f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Staff urge reform of the budget. ' WHEN doc_id % 7 = 3 THEN 'The authorities'' stance is that reform is essential! ' ELSE '' END || text AS text FROM documents), x AS (SELECT doc_id, {SENTENCES.format(t='text')} AS ss FROM d), s AS (SELECT doc_id, unnest(ss) AS sentence, unnest(range(0, len(ss))) AS at_ FROM x)
SELECT doc_id, at_ AS "at", CASE WHEN contains(lower(sentence), 'authorities') THEN 'authorities' WHEN contains(lower(sentence), 'staff') THEN 'staff' ELSE 'general' END AS attribution, length(sentence) AS chars FROM s WHERE length(sentence) >= 20 AND {_POLICY}"""
SQL["relevant_sentences"] = f"""{_PROSE} SELECT id, at_ AS "at", sentence FROM s WHERE length(sentence) >= 20 AND NOT {matches("sentence", L.RELEVANT_REJECT, "(?i)")} AND contains(lower(sentence), 'economic') AND contains(lower(sentence), 'outlook')"""
_CONTENT = f"list_filter(list_distinct(list_filter(string_split_regex(lower({{t}}), '\\s+'), lambda w: w <> '')), lambda w: w NOT IN ({', '.join(map(q, L.STOPWORDS))}))"
SQL["sentence_overlap"] = f"""WITH {cte('prose')}, x AS (SELECT a.id, {_CONTENT.format(t="a.content")} AS x, {_CONTENT.format(t="b.content")} AS y FROM prose a JOIN prose b ON b.id = a.id + 1)
SELECT id, round(CASE WHEN least(len(x), len(y)) > 0 THEN len(list_intersect(x, y)) / least(len(x), len(y))::DOUBLE ELSE 0.0 END, 6) AS overlap FROM x"""
SQL["citation_registry"] = f"WITH {cte('cites')}, f AS (SELECT query_id, chunk_id, min(pos) AS pos FROM cites GROUP BY ALL) SELECT query_id, chunk_id, '[' || dense_rank() OVER (PARTITION BY query_id ORDER BY pos) || ']' AS marker FROM f"
SQL["table_lookup"] = f"""WITH {cte('markdown')} SELECT 'q' AS query_id, table_id || ' (Page ' || page_number || '):' || chr(10) || chr(10) || content || chr(10) || chr(10) || '[1]' AS answer_text, 'DIRECT' AS answer_type, 'HIGH' AS confidence, id::VARCHAR AS cited, substr(content, 1, 100) AS quote FROM markdown WHERE modality = 'TABLE' AND table_id = 'Table 1'"""
SQL["paragraph_merge"] = f"""WITH {cte('spans')}, p AS (SELECT *, lag(text) OVER w AS t, lag(kind) OVER w AS k, lag(font_size) OVER w AS fs, lag(y1) OVER w AS py1 FROM spans WINDOW w AS (PARTITION BY page_number ORDER BY block_no)),
j AS (SELECT *, coalesce(k <> 'heading' AND kind <> 'heading' AND abs(fs - font_size) <= 0.5 AND NOT regexp_matches(rtrim(t), '[.!?:]$') AND (NOT regexp_matches(ltrim(text), '^\\p{{Lu}}') OR regexp_matches(substr(ltrim(text), 1, 3), '^[^\\p{{Ll}}]+$')) AND para IS NULL AND y0 - py1 <= 0.03, false) AS joins FROM p),
r AS (SELECT *, sum((NOT joins)::INT) OVER (PARTITION BY page_number ORDER BY block_no) AS run FROM j), n AS (SELECT *, (row_number() OVER (PARTITION BY page_number, run ORDER BY block_no) - 1) // 2 AS pair FROM r)
SELECT page_number, min(block_no) AS block_no, string_agg(text, ' ' ORDER BY block_no) AS text, count(*) AS merged, round(max(y1), 4) AS y1 FROM n GROUP BY page_number, run, pair"""
SQL["bbox_ops"] = f"""WITH {cte('boxes')} SELECT id, x0 >= 0 AND x0 <= x1 AND x1 <= 1 AND y0 >= 0 AND y0 <= y1 AND y1 <= 1 AS valid, x0 - 0.01 <= u0 AND y0 - 0.01 <= v0 AND x1 + 0.01 >= u1 AND y1 + 0.01 >= v1 AS holds,
 NOT (x1 < u0 OR u1 < x0 OR y1 < v0 OR v1 < y0) AS meets, round((x1 - x0) * (y1 - y0), 6) AS area, round(greatest(0.0, least(1.0, x0)), 6) AS nx0, round(greatest(0.0, least(1.0, 1 - y1)), 6) AS ny0 FROM boxes"""
SQL["bbox_union"] = f"WITH {cte('boxes')} SELECT id % 2 AS part, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY ALL"
SQL["overlap_antijoin"] = f"WITH {cte('regions')} SELECT id, page_number FROM regions h WHERE part = 'hit' AND NOT EXISTS (SELECT 1 FROM regions i WHERE i.part = 'image' AND i.page_number = h.page_number AND NOT (h.x1 < i.x0 OR i.x1 < h.x0 OR h.y1 < i.y0 OR i.y1 < h.y0))"
SQL["ocr_lines"] = f"""WITH {cte('ocr')}, l AS (SELECT image_no, line_no, string_agg(text, ' ' ORDER BY word_no) AS label, sum(confidence) AS c, count(*) AS n FROM ocr WHERE confidence >= 60 GROUP BY ALL)
SELECT image_no, string_agg(label, ';' ORDER BY label) AS labels, coalesce(string_agg(label, ';' ORDER BY label) FILTER (regexp_matches(label, '(?i)^(?:(?:19|20)\\d{{2}}|-?\\d+\\.?\\d*%?|.*\\b(?:percent|billion|million|index)\\b.*)$')), '') AS axis, round(sum(c) / sum(n), 4) AS confidence FROM l GROUP BY image_no"""
SQL["figure_titles"] = f"""WITH {cte('titles')} SELECT id, coalesce(nullif(regexp_extract(title, '(?i)(Text\\s+Figure\\s+\\d+)', 1), ''), nullif(regexp_extract(title, '(?i)(Figure\\s+\\d+[a-z]?)', 1), ''), nullif(regexp_extract(title, '(?i)(Figure\\s+[IVX]+)', 1), '')) AS figure_id,
 CASE WHEN regexp_matches(lower(title), 'chart|trend|growth') THEN 'LINE_CHART' WHEN regexp_matches(lower(title), 'bar|comparison') THEN 'BAR_CHART' WHEN regexp_matches(lower(title), 'pie|share|composition') THEN 'PIE_CHART' WHEN contains(lower(title), 'map') THEN 'MAP' WHEN regexp_matches(lower(title), 'diagram|flow|process') THEN 'DIAGRAM' ELSE 'CHART' END AS kind,
 CASE WHEN regexp_matches(title, '(?i)^Figure\\s+[1-5]\\b') AND width > 400 AND height > 300 THEN 6 WHEN width / greatest(height, 1) > 2.0 THEN 2 ELSE 1 END AS panels FROM titles"""
_EVAL = f"""WITH {cte('specs')}, x AS (SELECT *, list_filter(string_split(keywords, ';'), lambda w: w <> '') AS ws, string_split(lower(seen), ';') AS ms FROM specs),
y AS (SELECT *, len(list_filter(ws, lambda w: contains(lower(answer), lower(w)))) AS found, CASE WHEN expected_modality = 'mixed' THEN len(list_distinct(ms)) > 1 ELSE list_contains(ms, expected_modality) END AS modality_match FROM x),
r AS (SELECT *, round(CASE WHEN len(ws) = 0 THEN 1.0::DOUBLE ELSE found / len(ws)::DOUBLE END, 6) AS keyword_score FROM y), e AS (SELECT *, modality_match AND keyword_score >= 0.5 AS passed FROM r)"""
_FIGURES = "count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(100.0::DOUBLE * count(*) FILTER (passed) / count(*), 1) AS pass_rate, round(avg(keyword_score), 3) AS avg_keyword_score, round(100.0::DOUBLE * count(*) FILTER (modality_match) / count(*), 1) AS modality_match_rate"
SQL["eval_score"] = f"{_EVAL} SELECT query_id, modality_match, found AS keywords_found, keyword_score, passed, len(ms) AS chunks_retrieved FROM e"
SQL["eval_report"] = f"{_EVAL} SELECT 'overall' AS part, 'all' AS name, {_FIGURES} FROM e UNION ALL SELECT 'modality', expected_modality, {_FIGURES} FROM e GROUP BY ALL UNION ALL SELECT 'category', category, {_FIGURES} FROM e GROUP BY ALL"
SQL["eval_by_modality"] = f"{_EVAL} SELECT expected_modality, {_FIGURES}, list_position(['text', 'table', 'figure', 'mixed'], expected_modality) AS place FROM e GROUP BY expected_modality"
SQL["eval_by_category"] = f"{_EVAL} SELECT category, {_FIGURES} FROM e GROUP BY category"
SQL["eval_assessment"] = f"{_EVAL} SELECT round(100 * (0.6::DOUBLE * avg(keyword_score) + 0.4::DOUBLE * count(*) FILTER (passed) / count(*)), 2) AS points, round(count(DISTINCT expected_modality) FILTER (passed) / 3.0::DOUBLE, 4) AS modality_share FROM e"
