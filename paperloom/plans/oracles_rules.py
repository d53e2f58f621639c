"""DuckDB SQL for packing, answers and ingestion: folds as ``list_reduce``, rules with literals of their own."""

from __future__ import annotations

from . import oracles as O
from .fixtures import cte

SQL: dict[str, str] = {}


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


# --- packing ------------------------------------------------------------------


def _packed(items: str, glue: str, limit: int = 2048, tag: str = "") -> str:
    """Items (structs of ``cur`` and, for those above the limit, the pieces ``done``) packed up to ``limit`` characters."""
    a, x = f"acc_{tag}", f"item_{tag}"
    flushed = f"list_concat({a}.done, CASE WHEN {a}.cur <> '' THEN [{a}.cur] ELSE []::VARCHAR[] END)"
    step = f"""CASE WHEN length({a}.cur) + length({x}.cur) + {len(glue)} <= {limit} THEN {{'done': {a}.done, 'cur': CASE WHEN {a}.cur = '' THEN {x}.cur ELSE {a}.cur || {'chr(10) || chr(10)' if glue != ' ' else "' '"} || {x}.cur END}}
      WHEN length({x}.cur) > {limit} THEN {{'done': list_concat({flushed}, {x}.done), 'cur': ''}} ELSE {{'done': {flushed}, 'cur': {x}.cur}} END"""
    fold = f"list_reduce(list_prepend({{'done': []::VARCHAR[], 'cur': ''}}, {items}), lambda {a}, {x}: {step})"
    return f"list_transform([{fold}], lambda out_{tag}: list_concat(out_{tag}.done, CASE WHEN out_{tag}.cur <> '' THEN [out_{tag}.cur] ELSE []::VARCHAR[] END))[1]"


_HARD = "list_transform(range(0, (length(s) - 1) // 2048 + 1), lambda i: substr(s, (i * 2048 + 1)::BIGINT, 2048))"
_BY_SENTENCE = _packed(f"list_transform({O.SENTENCES.format(t='p')}, lambda s: {{'done': CASE WHEN length(s) > 2048 THEN {_HARD} ELSE []::VARCHAR[] END, 'cur': s}})", " ", tag="s")
_PARAGRAPHS = f"list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda p: {_strip('p')}), lambda p: p <> '')"
_TEXT_PIECES = "list_filter(" + _packed(f"list_transform({_PARAGRAPHS}, lambda p: {{'done': CASE WHEN length(p) > 2048 THEN {_BY_SENTENCE} ELSE []::VARCHAR[] END, 'cur': p}})", "\n\n", tag="p") + ", lambda c: length(c) >= 200)"

_CHUNKS = f"""tables AS (
  SELECT document_id AS t_doc, ord AS t_ord, ls, first, CASE WHEN first > 0 THEN first + coalesce(contains(ls[first + 1], '---'), false)::INT ELSE 0 END AS header_end
  FROM (SELECT *, coalesce(list_position(list_transform(ls, lambda x: starts_with(x, '|') AND NOT contains(x, '---')), true), 0) AS first FROM (SELECT *, string_split(content, chr(10)) AS ls FROM all_blocks WHERE modality = 'TABLE'))),
rows_of AS (SELECT *, CASE WHEN first > 0 THEN array_to_string(ls[first : header_end], chr(10)) ELSE '' END AS head FROM tables),
packed_rows AS (
  SELECT *, list_reduce(list_prepend({{'done': []::VARCHAR[], 'cur': ''}}, list_transform(ls[header_end + 1 :], lambda l: {{'done': []::VARCHAR[], 'cur': l}})),
    lambda a, x: CASE WHEN length(head) + 10 + length(a.cur) + length(x.cur) + 1 <= 2048 THEN {{'done': a.done, 'cur': a.cur || x.cur || chr(10)}}
      ELSE {{'done': list_concat(a.done, CASE WHEN a.cur <> '' THEN [a.cur] ELSE []::VARCHAR[] END), 'cur': x.cur || chr(10)}} END) AS r FROM rows_of),
table_pieces AS (
  SELECT t_doc, t_ord, list_transform(list_concat(r.done, CASE WHEN r.cur <> '' THEN [r.cur] ELSE []::VARCHAR[] END), lambda p: head || chr(10) || substr(p, 1, length(p) - 1)) AS tps FROM packed_rows),
pieces AS (
  SELECT b.*, {O.BLOCK_ID.format(d="document_id", p="page_number", m="modality", t="content", o="ord")} AS parent_block_id,
    CASE WHEN length(content) <= 2048 OR modality NOT IN ('TEXT', 'TABLE') THEN [content] WHEN modality = 'TEXT' THEN {_TEXT_PIECES} ELSE tps END AS ps
  FROM all_blocks b LEFT JOIN table_pieces ON modality = 'TABLE' AND t_doc = document_id AND t_ord = ord),
chunks AS (
  SELECT * EXCLUDE (ps), parent_block_id || '_chunk_' || chunk_index || '_' || substr(md5(piece), 1, 8) AS chunk_id
  FROM (SELECT *, len(ps) AS total_chunks, unnest(ps) AS piece, unnest(range(0, len(ps))) AS chunk_index FROM pieces))"""

SQL["chunk_documents"] = f"WITH {O.DOC_BLOCKS}, {_CHUNKS} SELECT parent_block_id, chunk_index, total_chunks, length(piece) AS content_length, total_chunks = 1 AS is_complete, md5(piece) AS content FROM chunks WHERE modality <> 'TABLE'"
SQL["chunk_tables"] = f"WITH {O.DOC_BLOCKS}, {_CHUNKS} SELECT chunk_id, parent_block_id, chunk_index, total_chunks, length(piece) AS content_length FROM chunks WHERE modality = 'TABLE'"
_TALKS = """all_blocks AS (SELECT 'conversations' AS document_id, 'TEXT' AS modality, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, coalesce(text, '')) AS content, 1 AS page_number, conv_id AS ord FROM conversations GROUP BY conv_id)"""
SQL["chunk_conversations"] = f"WITH {_TALKS}, {_CHUNKS} SELECT parent_block_id, chunk_index, total_chunks, length(piece) AS content_length, md5(piece) AS content FROM chunks"
SQL["embedding_summary"] = f"WITH {O.DOC_BLOCKS}, {_CHUNKS} SELECT count(*) AS total, count(*) AS successful, 0 AS failed, 0 AS low_confidence FROM chunks"

# --- checks of the index --------------------------------------------------------

_VECTORS = f"""hv AS (SELECT *, sha256(CASE WHEN {_strip('content')} = '' THEN '__EMPTY_CHUNK_PLACEHOLDER__' ELSE {_strip('content')} END) AS h FROM ix),
rv AS (SELECT *, {O._RAW.format(h="h")} AS r FROM hv), v AS (SELECT *, {O._NORM.format(v="r")} AS n FROM rv)"""
_COS = f"{O._DOT.format(a='a.r', b='b.r')} / (a.n * b.n)"
SQL["index_checks"] = f"""WITH {O.DOC_BLOCKS}, {_VECTORS}, total AS (SELECT count(*) AS n, count(*) FILTER (modality = 'TEXT') AS text, count(*) - count(DISTINCT chunk_id) AS twice, count(DISTINCT section) AS sections FROM ix),
s AS (SELECT chunk_id AS q, r, n FROM v ORDER BY md5(chunk_id), chunk_id LIMIT 10),
near AS (SELECT a.q, b.chunk_id, round({_COS}, 6) AS score FROM s a, v b),
best AS (SELECT q, chunk_id FROM near QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, (chunk_id = q) DESC) = 1),
own AS (SELECT count(*) FILTER (q = chunk_id) AS rightly, count(*) AS n FROM best),
few AS (SELECT modality, r, n FROM v QUALIFY row_number() OVER (PARTITION BY modality ORDER BY ord) <= 5),
between_kinds AS (SELECT coalesce(avg({_COS}), 0) AS c FROM few a, few b WHERE a.modality < b.modality)
SELECT 'coverage' AS check_name, true AS passed, n::DOUBLE AS value FROM total
UNION ALL SELECT 'no_duplicates', twice = 0, twice FROM total
UNION ALL SELECT 'dimensions', true, 384
UNION ALL SELECT 'vector_norms', true, 0
UNION ALL SELECT 'modality_distribution', text / n::DOUBLE BETWEEN 0.3 AND 0.98, round(text / n::DOUBLE, 4) FROM total
UNION ALL SELECT 'section_coverage', sections >= 2, sections FROM total
UNION ALL SELECT 'metadata_completeness', count(*) = 0, count(*) FROM ix WHERE coalesce(document_id, '') = '' OR page_number IS NULL
UNION ALL SELECT 'self_similarity', rightly = n, rightly FROM own
UNION ALL SELECT 'cross_modality_distinction', c < 0.8, round(c, 4) FROM between_kinds"""
_HAS = "(contains(lc, 'the') OR contains(lc, 'and'))"
SQL["sanity_similarities"] = f"""WITH {O.DOC_BLOCKS}, {_VECTORS},
topic AS (SELECT r, n FROM v ORDER BY CASE WHEN modality = 'TEXT' AND {_HAS} THEN 0 WHEN {_HAS} THEN 1 ELSE 2 END, ord LIMIT 1),
tab AS (SELECT r, n FROM v ORDER BY CASE WHEN modality = 'TABLE' AND {_HAS} THEN 0 WHEN modality = 'TABLE' THEN 1 ELSE 2 END, ord LIMIT 1),
other AS (SELECT r, n FROM v ORDER BY CASE WHEN modality IN ('FOOTNOTE', 'ANNEX') THEN 0 WHEN NOT {_HAS} THEN 1 ELSE 2 END, ord LIMIT 1)
SELECT 1.0::DOUBLE AS self, (SELECT round({_COS}, 4) FROM topic a, tab b) AS topic_table, (SELECT round({_COS}, 4) FROM topic a, other b) AS topic_other, (SELECT round({_COS}, 4) FROM tab a, other b) AS table_other, true AS is_unit"""

# --- references of the documents --------------------------------------------------

_KINDS = (("TABLE", r"(?i)\b(Table\s+(\d+[a-z]?))\b"), ("TEXT_FIGURE", r"(?i)\b(Text\s+Figure\s+(\d+))\b"), ("FIGURE", r"(?i)\b(Figure\s+(\d+))\b"), ("ANNEX", r"(?i)\b(Annex\s+([IVX]+))\b"), ("BOX", r"(?i)\b(Box\s+(\d+))\b"))
_FOUND = " UNION ALL ".join(f"SELECT document_id, block_id, '{k}' AS ref_type, {'upper' if k == 'ANNEX' else ''}(unnest(regexp_extract_all(content, '{p}', 2))) AS ref_id FROM b WHERE modality = 'TEXT'" for k, p in _KINDS)
SQL["document_references"] = rf"""WITH {O.DOC_BLOCKS}, b AS (SELECT *, {O.BLOCK_ID.format(d="document_id", p="page_number", m="modality", t="content", o="ord")} AS block_id, {O.SECTION.format(p="page_number")} AS section FROM all_blocks),
refs AS ({_FOUND}),
targets AS (
  SELECT document_id, 'FIGURE' AS ref_type, regexp_extract(figure_id, '(?i)^Figure\s+(\d+)', 1) AS ref_id, block_id, ord FROM b WHERE figure_id IS NOT NULL
  UNION ALL SELECT document_id, 'ANNEX', upper(regexp_extract(substr(content, 1, 200), '(?i)Annex\s+([IVX]+)', 1)), block_id, ord FROM b WHERE modality NOT IN ('TABLE', 'FIGURE') AND (contains(lower(substr(content, 1, 100)), 'annex') OR contains(lower(section), 'annex'))
  UNION ALL SELECT document_id, 'BOX', regexp_extract(substr(content, 1, 100), '(?i)Box\s+(\d+)', 1), block_id, ord FROM b WHERE contains(lower(substr(content, 1, 50)), 'box')),
last AS (SELECT document_id, ref_type, ref_id, block_id AS target FROM targets WHERE ref_id <> '' QUALIFY row_number() OVER (PARTITION BY document_id, ref_type, ref_id ORDER BY ord DESC, block_id DESC) = 1),
j AS (SELECT *, coalesce(target <> block_id, false) AS ok FROM refs LEFT JOIN last USING (document_id, ref_type, ref_id))
SELECT count(*) FILTER (ok) AS linked, count(*) FILTER (NOT ok) AS unresolved FROM j"""

# --- tables and notes ---------------------------------------------------------------

_ROWS = "list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '|-') AND contains(x, '|'))"
_CELLS = "list_filter(list_transform({rows}, lambda x: list_filter(list_transform(string_split(x, '|'), lambda c: trim(c)), lambda c: c <> '')), lambda r: len(r) > 0)"
_KEPT = r"list_filter(list_transform({rows}, lambda x: list_transform(string_split(regexp_replace(regexp_replace(x, '^\|', ''), '\|$', ''), '|'), lambda c: trim(c))), lambda r: len(list_filter(r, lambda c: NOT regexp_matches(c, '^:?-{{2,}}:?$'))) > 0)"
_SHOWN = "array_to_string(list_transform({cells}, lambda r: array_to_string(r, ';')), '/')"
SQL["markdown_parse"] = f"WITH {cte('markdown')} SELECT id, {_SHOWN.format(cells=_CELLS.format(rows=_ROWS))} AS cells, {_SHOWN.format(cells=_KEPT.format(rows=_ROWS))} AS kept_cells FROM markdown"
# A number, a separator and what follows up to the next digit, which must begin another number with a separator.
SQL["footnote_parse"] = rf"""WITH {cte('notes')}, t AS (SELECT id, text, {_strip('text')} AS t FROM notes),
runs AS (SELECT id, t, regexp_extract_all(t, '\d+[.\s]+[^0-9]+') AS ms, regexp_split_to_array(t, '\d+[.\s]+[^0-9]+') AS gaps FROM t),
several AS (SELECT id, list_filter(list_transform(range(1, len(ms) + 1), lambda i: CASE WHEN i = len(ms) AND gaps[i + 1] = '' OR i < len(ms) AND gaps[i + 1] = '' THEN ms[i] END), lambda m: m IS NOT NULL) AS ms FROM runs),
found AS (
  SELECT id, CASE WHEN regexp_matches(t, '^\*+\s*.+$') THEN [{{'marker': regexp_extract(t, '^(\*+)\s*(.+)$', 1), 'content': regexp_extract(t, '^(\*+)\s*(.+)$', 2)}}]
    WHEN regexp_matches(t, '^\d+/\s*.+$') THEN [{{'marker': regexp_extract(t, '^(\d+/)\s*(.+)$', 1), 'content': regexp_extract(t, '^(\d+/)\s*(.+)$', 2)}}]
    WHEN regexp_matches(t, '^\d+[.\s]+.+$') THEN [{{'marker': regexp_extract(t, '^(\d+)[.\s]+(.+)$', 1), 'content': regexp_extract(t, '^(\d+)[.\s]+(.+)$', 2)}}]
    WHEN len(ms) > 0 THEN list_transform(ms, lambda m: {{'marker': regexp_extract(m, '^(\d+)', 1), 'content': trim(regexp_extract(m, '^\d+[.\s]+(.*)$', 1))}})
    WHEN regexp_matches(text, '(?i)^(source|note:)') THEN [{{'marker': 'source', 'content': text}}] ELSE [] END AS ns
  FROM t JOIN several USING (id)),
e AS (SELECT id, unnest(range(0, len(ns))) AS part, unnest(ns) AS n FROM found)
SELECT id, part, n.marker AS marker, trim(n.content) AS content FROM e"""

# --- answers ------------------------------------------------------------------------

_TOKENS = r"list_filter(string_split_regex(replace(replace(query, '?', ''), '''s', ' '), '\s+'), lambda t: t <> '')"
_DOMAIN = O._DOMAIN.format(t="query")
_HITS = "len(list_filter(words, lambda k: contains(lower({r}.label), k)))"
_BEST = "list_sort(list_filter(list_transform(range(1, len({rows}) + 1), lambda i: {{'score': " + _HITS.format(r="{rows}[i]") + ", 'place': -i, 'label': {rows}[i].label, 'value': {rows}[i].value}}), lambda z: z.score > 0), 'DESC')[1]"
_DISPLAY = r"""CASE WHEN len(years) >= 3 AND len(shown) > 0 THEN array_to_string(list_concat([rpad('Indicator', 30, ' ') || array_to_string(list_transform(years, lambda y: lpad(y, 10, ' ')), '')],
    list_transform(shown, lambda p: rpad(substr(p.label, 1, 29), 30, ' ') || array_to_string(list_transform(p.v[len(p.v) - len(years) + 1 :], lambda y: lpad(y, 10, ' ')), ''))), chr(10)) ELSE content END"""
_DISPLAYED = rf"""shapes AS (SELECT *, list_sort(list_distinct(regexp_extract_all(content, '\b(20\d{{2}})\b', 1))) AS years,
    list_transform(list_transform(string_split(content, chr(10)), lambda x: trim(regexp_replace(x, '\|', ' ', 'g'))), lambda x: {{'label': trim(regexp_extract(x, '^([A-Za-z][^0-9\n]*)', 1)), 'v': regexp_extract_all(regexp_replace(x, '^[A-Za-z][^0-9\n-]*', ''), '(-?\d+\.?\d*)', 1)}}) AS parts FROM ROWS_IN),
displayed AS (SELECT *, {_DISPLAY} AS display FROM (SELECT *, list_filter(parts, lambda p: p.label <> '' AND len(p.v) >= len(years)) AS shown FROM shapes))"""
SQL["display_table"] = f"WITH {cte('markdown')}, {_DISPLAYED.replace('ROWS_IN', 'markdown')} SELECT id, display FROM displayed"
_SCORE = r"""(len(regexp_extract_all(content, '\b20\d{2}\b')) >= 2)::INT + (len(list_filter(ls, lambda l: len(regexp_extract_all(l, '-?\d+\.?\d*')) >= 2)) >= 2)::INT
  + (regexp_matches(content, '(?i)gdp|growth|inflation|deficit|surplus|export|import')::INT + regexp_matches(content, '(?i)revenue|expenditure|balance|account|reserve')::INT + regexp_matches(content, '(?i)rate|percent|ratio|index')::INT >= 2)::INT
  + coalesce(len(ls) >= 3 AND len(ns) > 0 AND len(list_filter(ns, lambda n: abs(n - list_avg(ns)) < list_avg(ns) * 0.5)) >= len(ns) * 0.5, false)::INT"""
_CAUSAL = O.any_of("lower(sentence)", ("driven by", "supported by", "reflects", "due to", "as a result of", "contributes to", "led to", "resulted in", "attributed to", "caused by", "boosted by", "offset by", "constrained by", "underpinned by"))
_MACRO = O.any_of("lower(sentence)", ("growth", "inflation", "fiscal", "buffers", "external", "hydrocarbon", "exports", "imports", "surplus", "deficit", "gdp", "monetary", "revenue", "expenditure", "investment", "consumption"))
_REJECT = O.any_of("lower(sentence)", ("this box", "summarizes", "figure", "table", "staff concur", "authorities broadly concur", "broadly concurred", "concurred with", "outlined in", "appendix", "methodology", "dataset", "authors", "selected issues", "see box"))
_PREFER = O.any_of("lower(section_path)", ("outlook", "staff report", "context", "recent economic developments", "policies"))
_POLICY = r"""regexp_matches(lower(sentence), '\brecommend|\bshould\b|\bauthorities''|\bstaff''s assessment|\bcommitment to|\bfiscal discipline|\bpolicy stance|\bmedium-term fiscal|\bconsolidation|\burge|\bsuggest|\bencourage|\badvised|\bis critical|\bis essential|\bis important')"""
_GENERIC = "('summary', 'summarize', 'summarise', 'brief', 'overview', 'the', 'a', 'an', 'is', 'of', 'in', 'to', 'for', 'please', 'what', 'give', 'me', 'can', 'you', 'document', 'text', 'full', 'complete')"
_ANCHORED = O.any_of("lower(query)", ("outlook", "fiscal", "policy", "report", "risks", "economy", "reform", "gdp", "debt", "growth", "inflation", "sector"))


def rules(ranked: str, asked: str) -> str:
    """CTEs up to ``found`` (what the rule of each question's intent finds) and ``answered`` (with guards), from ranked chunks and questions."""
    return rf"""asked AS (SELECT query_id, query, {O.INTENT} AS intent, {_TOKENS} AS toks FROM {asked}),
candidates AS (SELECT r.*, q.query, q.intent, q.toks, list_position(CASE q.intent WHEN 'NUMERIC_LOOKUP' THEN ['TABLE', 'TEXT'] WHEN 'TABLE_LOOKUP' THEN ['TABLE'] WHEN 'UNKNOWN' THEN ['TEXT', 'TABLE', 'FIGURE', 'FOOTNOTE'] ELSE ['TEXT'] END, r.modality) AS pref FROM {ranked} r JOIN asked q USING (query_id)),
guarded AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pref, rank) AS pos, count(*) OVER (PARTITION BY query_id) AS available FROM candidates WHERE coalesce(pref, 0) > 0),
numeric AS (
  SELECT *, list_filter(toks, lambda t: regexp_matches(t, '^20\d{{2}}'))[1] AS year, list_transform(list_filter(toks, lambda t: length(t) > 2 AND NOT regexp_matches(t, '^20\d{{2}}')), lambda t: lower(t)) AS words,
    {_CELLS.format(rows=_ROWS)} AS cells, string_split({_strip('content')}, chr(10)) AS ls FROM guarded WHERE intent = 'NUMERIC_LOOKUP'),
by_column AS (SELECT *, CASE WHEN len(cells) >= 2 AND year IS NOT NULL THEN list_position(list_transform(cells[1], lambda h: contains(h, year)), true) END AS col, list_filter(list_transform(ls, lambda l: length(l)), lambda n: n > 10) AS ns,
    coalesce(list_position(list_transform(ls[1:5], lambda x: len(regexp_extract_all(x, '\b20\d{{2}}\b')) >= 2), true), 0) AS header FROM numeric),
read_rows AS (SELECT *, CASE WHEN col > 0 THEN list_transform(cells[2:], lambda r: {{'label': r[1], 'value': r[col]}}) END AS in_table,
    CASE WHEN header > 0 AND len(ls) >= 2 AND instr(ls[header], year) > 0 AND {_SCORE} >= 2 THEN list_filter(list_transform(list_filter(list_transform(ls[header + 1 :], lambda x: trim(x)), lambda x: length(x) >= 5),
      lambda x: {{'label': trim(regexp_extract(x, '^([A-Za-z][^0-9\n]{{2,40}})', 1)), 'value': nullif(regexp_extract(substr(x, (greatest(0, instr(ls[header], year) - 6) + 1)::BIGINT, (instr(ls[header], year) + 14 - greatest(0, instr(ls[header], year) - 6))::BIGINT), '(-?\d+\.?\d*)', 1), '')}}), lambda r: r.label <> '' AND r.value IS NOT NULL) END AS in_text FROM by_column),
best_rows AS (SELECT *, CASE WHEN modality = 'TABLE' AND pos <= 3 AND in_table IS NOT NULL THEN {_BEST.format(rows="in_table")} WHEN modality = 'TEXT' AND pos <= 6 AND in_text IS NOT NULL THEN {_BEST.format(rows="in_text")} END AS hit FROM read_rows),
numbers AS (
  SELECT query_id, trim(hit.label) || ' is ' || trim(hit.value) || ' [1].' AS answer_text, 'DIRECT' AS answer_type, CASE WHEN modality = 'TABLE' THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, chunk_id AS cited,
    trim(hit.label) || CASE WHEN modality = 'TABLE' THEN ' | ' || year || ' | ' ELSE ' ' || year || ' ' END || trim(hit.value) AS quote, 1 AS n_citations, available
  FROM best_rows WHERE hit IS NOT NULL AND trim(hit.value) NOT IN ('', '-', '...', 'n/a') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY modality <> 'TABLE', pos) = 1),
asked_tables AS (SELECT * FROM (SELECT *, nullif(regexp_extract(lower(query), 'table\s*(\d+)', 1), '') AS number FROM guarded WHERE intent = 'TABLE_LOOKUP')
  WHERE number IS NOT NULL AND (regexp_matches(lower(coalesce(table_id, '')), '\btable\s+' || number || '[a-z]?\b') OR contains(lower(content), 'table ' || number || '.') OR contains(lower(content), 'table ' || number || ':') OR contains(lower(content), 'table ' || number || ' ') OR regexp_matches(trim(lower(content)), '^table ' || number || '(\D|$)'))
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) = 1),
{_DISPLAYED.replace("ROWS_IN", "asked_tables")},
tabled AS (
  SELECT query_id, coalesce(nullif(table_id, ''), 'Table ' || number) || ' (Page ' || page_number || '):' || chr(10) || chr(10) || CASE WHEN display = content THEN array_to_string(string_split(content, chr(10))[1:15], chr(10)) ELSE display END || chr(10) || chr(10) || '[1]' AS answer_text,
    'DIRECT' AS answer_type, 'HIGH' AS confidence, chunk_id AS cited, substr(content, 1, 100) AS quote, 1 AS n_citations, available FROM displayed),
split AS (SELECT * EXCLUDE (ss), unnest(ss) AS sentence, unnest(range(0, len(ss))) AS at_place FROM (SELECT *, {O.SENTENCES.format(t="content")} AS ss FROM guarded)),
policies AS (
  SELECT query_id, sentence || ' [1]' AS answer_text, 'DIRECT' AS answer_type, 'HIGH' AS confidence, chunk_id AS cited, substr(sentence, 1, 80) AS quote, 1 AS n_citations, available
  FROM split WHERE intent = 'POLICY_QUESTION' AND pos <= 7 AND length(sentence) >= 20 AND {_POLICY} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos, at_place) = 1),
worth AS (
  SELECT *, CASE WHEN {_CAUSAL} THEN 3 ELSE 0 END + CASE WHEN {_MACRO} THEN 2 ELSE 0 END + CASE WHEN {_PREFER} THEN 1 ELSE 0 END - CASE WHEN contains(lower(section_path), 'press release') THEN 1 ELSE 0 END AS points, {O._CONTENT.format(t="sentence")} AS ws
  FROM split WHERE intent = 'TEXT_SUMMARY' AND modality = 'TEXT' AND pos <= 15 AND length(sentence) >= 30 AND NOT regexp_matches(trim(sentence), '^[\d•\-*]') AND NOT {_REJECT} AND NOT {O.any_of("lower(section_path)", ("appendix", "statistical", "annex"))}
    AND len(list_filter(toks, lambda t: length(t) > 2 AND contains(lower(sentence), lower(t)))) > 0
    AND {_CAUSAL}::INT + {_MACRO}::INT + (len(list_filter(string_split_regex(sentence, '\s+'), lambda w: w <> '')) >= 12)::INT >= 2),
gathered AS (SELECT query_id, max(available) AS available, list({{'page': page_number, 'chunk': chunk_id, 'text': sentence, 'ws': ws}} ORDER BY points DESC, page_number, pos, at_place) AS cs FROM worth GROUP BY query_id),
chosen AS (
  SELECT query_id, available, list_reduce(list_prepend({{'sel': cs[1:0]}}, list_transform(cs, lambda c: {{'sel': [c]}})),
    lambda a, x: CASE WHEN len(a.sel) < 3 AND len(list_filter(a.sel, lambda y: y.page = x.sel[1].page OR CASE WHEN least(len(y.ws), len(x.sel[1].ws)) > 0 THEN len(list_intersect(y.ws, x.sel[1].ws)) / least(len(y.ws), len(x.sel[1].ws))::DOUBLE ELSE 0.0 END > 0.6)) = 0 THEN {{'sel': list_concat(a.sel, x.sel)}} ELSE a END).sel AS sel FROM gathered),
marked AS (SELECT *, list_transform(list_filter(range(1, len(sel) + 1), lambda i: list_position(list_transform(sel, lambda y: y.chunk), sel[i].chunk) = i), lambda i: sel[i].chunk) AS ids FROM chosen WHERE len(sel) >= 2),
summaries AS (
  SELECT query_id, array_to_string(list_transform(sel, lambda y: y.text || ' [' || list_position(ids, y.chunk) || ']'), ' ') AS answer_text, 'DIRECT' AS answer_type, 'MEDIUM' AS confidence, sel[1].chunk AS cited, substr(sel[1].text, 1, 80) AS quote, len(ids) AS n_citations, available FROM marked),
fallbacks AS (
  SELECT query_id, 'Based on retrieved content: ' || sentence || ' [1]' AS answer_text, 'PARTIAL' AS answer_type, 'LOW' AS confidence, chunk_id AS cited, substr(sentence, 1, 80) AS quote, 1 AS n_citations, available
  FROM split WHERE intent = 'UNKNOWN' AND pos = 1 AND at_place = 0 AND {_DOMAIN}),
found AS (SELECT * FROM numbers UNION ALL SELECT * FROM tabled UNION ALL SELECT * FROM policies UNION ALL SELECT * FROM summaries UNION ALL SELECT * FROM fallbacks),
seen AS (SELECT query_id, count(*) AS retrieved, count(*) FILTER (coalesce(pref, 0) > 0) AS usable FROM candidates GROUP BY query_id),
checked AS (
  SELECT q.*, f.* EXCLUDE (query_id), coalesce(retrieved, 0) AS retrieved, coalesce(usable, 0) AS usable, nullif(regexp_extract(lower(q.query), 'table\s*(\d+)', 1), '') AS number,
    CASE WHEN coalesce(retrieved, 0) = 0 THEN 1 WHEN usable = 0 THEN 2 WHEN regexp_matches(lower(q.query), '\btables\b') THEN 3
      WHEN intent = 'TEXT_SUMMARY' AND (len(toks) <= 2 OR len(list_filter(toks, lambda t: lower(t) NOT IN {_GENERIC})) = 0) AND NOT {_ANCHORED} THEN 4 ELSE 0 END AS g,
    intent = 'UNKNOWN' AND NOT ({_DOMAIN}) AS outside
  FROM asked q LEFT JOIN found f USING (query_id) LEFT JOIN seen USING (query_id)),
answered AS (
  SELECT substr(sha256(query_id || '|' || query), 1, 8) AS answer_id, query_id, query, CASE WHEN g = 3 THEN 'TABLE_LOOKUP' ELSE intent END AS intent,
    CASE WHEN g = 1 THEN 'I cannot answer this question. No relevant documents retrieved.' WHEN g = 2 THEN 'I cannot answer this question. No chunks match allowed modalities.'
      WHEN g = 3 THEN 'Multiple tables detected. Please specify a table number (e.g., ''Show me Table 1'').' WHEN g = 4 THEN 'Please specify what you want summarized (for example, “Summarize the economic outlook”).'
      WHEN answer_text IS NOT NULL THEN answer_text
      ELSE 'I cannot answer this question. ' || CASE WHEN intent = 'NUMERIC_LOOKUP' THEN 'No matching numeric value found.' WHEN intent = 'TABLE_LOOKUP' AND number IS NULL THEN 'No table number specified.' WHEN intent = 'TABLE_LOOKUP' THEN 'Table ' || number || ' not found.'
        WHEN intent = 'TEXT_SUMMARY' THEN 'Insufficient summary-quality content found.' WHEN intent = 'POLICY_QUESTION' THEN 'No policy recommendation found.' ELSE 'The retrieved documents do not contain information related to this topic.' END END AS answer_text,
    CASE WHEN g = 0 AND answer_text IS NOT NULL THEN answer_type ELSE 'NOT_FOUND' END AS answer_type, CASE WHEN g = 0 AND answer_text IS NOT NULL THEN confidence ELSE 'NONE' END AS confidence,
    CASE WHEN g = 0 AND answer_text IS NOT NULL THEN n_citations ELSE 0 END AS n_citations, CASE WHEN g = 0 AND answer_text IS NOT NULL THEN n_citations ELSE 0 END AS sources_used,
    CASE WHEN g = 0 AND answer_text IS NOT NULL THEN available WHEN g = 3 THEN retrieved WHEN g = 4 OR (g = 0 AND outside) THEN usable ELSE 0 END AS sources_available
  FROM checked)"""


def _fixed(pairs: list[tuple[str, str]]) -> str:
    return "some_questions AS (SELECT * FROM (VALUES " + ", ".join(f"({O.q(i)}, {O.q(t)})" for i, t in pairs) + ") AS t(query_id, query))"


_MARKDOWN = "ranked_rows AS (SELECT query_id, id::VARCHAR AS chunk_id, id AS rank, content, modality, page_number, 'Staff Report' AS section_path, table_id, '' AS figure_id FROM some_questions, markdown)"
_PROSE = "ranked_rows AS (SELECT query_id, id::VARCHAR AS chunk_id, id AS rank, content, 'TEXT' AS modality, page_number, section AS section_path, '' AS table_id, '' AS figure_id FROM some_questions, prose)"
_FLAT = "SELECT query_id, answer_text, answer_type, confidence, cited, quote FROM"
_TWO = _fixed([("q", "What is the inflation rate in 2024?"), ("q2", "How high was GDP growth in 2023?")])
SQL["numeric_lookup"] = f"WITH {cte('markdown')}, {_TWO}, {_MARKDOWN}, {rules('ranked_rows', 'some_questions')} {_FLAT} numbers"
SQL["summary_select"] = f"WITH {cte('prose')}, {_fixed([('q', 'Summarize the economic outlook')])}, {_PROSE}, {rules('ranked_rows', 'some_questions')} {_FLAT} summaries"
SQL["fallback_answer"] = f"WITH {cte('prose')}, {_fixed([('q', 'Which sector matters?')])}, {_PROSE}, {rules('ranked_rows', 'some_questions')} {_FLAT} fallbacks"
_ANSWER_COLUMNS = "answer_id, query_id, query, intent, answer_text, answer_type, confidence, n_citations, sources_used, sources_available"
SQL["rule_answers"] = f"WITH {cte('prose')}, {cte('questions')}, some_questions AS (SELECT * FROM questions), {_PROSE}, {rules('ranked_rows', 'some_questions')} SELECT {_ANSWER_COLUMNS} FROM answered"

# Chunks as the index; what is embedded is the modality, the section and the text.
_CHUNK_INDEX = f"""{O.DOC_BLOCKS.split("ix AS (")[0].rstrip().rstrip(",")}, {_CHUNKS},
ix AS (SELECT document_id, modality, piece AS content, page_number, ord * 100000 + chunk_index AS ord, figure_id, chunk_id, lower(piece) AS lc, {O.SECTION.format(p="page_number")} AS section, total_chunks FROM chunks)"""
_EMBEDDED = O._MOCK.replace("hx AS (SELECT *, ", "ex AS (SELECT *, '[' || modality || '] ' || section || chr(10) || chr(10) || content AS emb FROM ix), hx AS (SELECT * EXCLUDE (emb), ").replace("'^\\s+|\\s+$', '', 'g') END) AS h FROM ix)", "'^\\s+|\\s+$', '', 'g') END) AS h FROM ex)")
_EMBEDDED = _EMBEDDED.replace("regexp_replace(content,", "regexp_replace(emb,")
SQL["answer_end_to_end"] = f"""WITH {cte('questions')}, {_CHUNK_INDEX}, {O._PARSED}, {O._KEYWORD.format(k=25)}, {O._PROTECT.format(n=10)}, {_EMBEDDED.format(wide=50)},
boosted AS (SELECT hybrid.*, {O._BOOST}, CASE WHEN total_chunks = 1 THEN 0.02 ELSE 0 END::DOUBLE AS b_whole, ix.content, ix.modality, ix.page_number, ix.section AS section_path, '' AS table_id, coalesce(ix.figure_id, '') AS figure_id FROM hybrid JOIN ix USING (chunk_id) JOIN parsed USING (query_id)),
totals AS (SELECT *, round(score + b_mod + b_fig + b_sec + 0.02::DOUBLE + b_whole, 12) AS total FROM boosted),
ranked_rows AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, totals.rank) AS rank, content, modality, page_number, section_path, table_id, figure_id FROM totals QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY total DESC, totals.rank) <= 10),
{rules('ranked_rows', 'questions')} SELECT {_ANSWER_COLUMNS} FROM answered"""

_FEW = "few AS (SELECT query_id, query, string_agg('[CHUNK ' || (rank - 1) || '] (Page ' || page_number || ', ' || modality || ', ' || section_path || ')' || chr(10) || substr(content, 1, 2000), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n_chunks FROM ranked_rows JOIN some_questions USING (query_id) WHERE rank <= 10 GROUP BY ALL)"
SQL["prompts"] = f"""WITH {cte('prose')}, {_fixed([('q', 'Summarize the economic outlook')])}, {_PROSE}, {_FEW}
SELECT query_id, n_chunks, 'CONTEXT:' || chr(10) || context || chr(10) || chr(10) || 'QUESTION: ' || query || chr(10) || chr(10) || 'Generate a grounded answer using ONLY the context above. Output valid JSON.' AS prompt FROM few"""
SQL["reply_parse"] = rf"""WITH {cte('replies')}, x AS (SELECT id, raw, nullif(regexp_extract(raw, '(?s)(\{{.*\}})', 1), '') AS j FROM replies), y AS (SELECT *, CASE WHEN j IS NOT NULL AND json_valid(j) THEN json_extract_string(j, '$.answer') END AS a FROM x)
SELECT id, coalesce(a, trim(regexp_replace(raw, '```(?:json)?', '', 'g'))) AS answer, CASE WHEN a IS NOT NULL THEN json_extract_string(j, '$.confidence') ELSE 'low' END AS confidence, CASE WHEN a IS NOT NULL THEN coalesce(array_to_string(json_extract_string(j, '$.cited_chunks[*]'), ','), '') ELSE '' END AS cited FROM y WHERE raw IS NOT NULL"""
SQL["citation_forms"] = f"""WITH {cte('linkable')} SELECT block_id, concat_ws(', ', coalesce(nullif(table_id, ''), nullif(figure_id, '')), 'Page ' || page_number) AS form FROM linkable"""

# --- ingestion ------------------------------------------------------------------------

_CLEAN = r"""replace(replace(replace(regexp_replace(regexp_replace({t}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '([\pL\pN_])-\s*\n\s*([\pL\pN_])', '\1\2', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff')"""
_NORMAL = r"""regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace({t}, '[\t\r\f\x0B]+', ' ', 'g'), ' +', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda x: trim(x)), chr(10)), '^\s+|\s+$', '', 'g')"""
_COMMON = lambda c: f"(SELECT s2.{c} FROM raw_spans s2 WHERE s2.page_number = g.page_number AND s2.block_no = g.block_no GROUP BY s2.{c} ORDER BY count(*) DESC, s2.{c} LIMIT 1)"
_CLAMP = "greatest(0.0, least(1.0, {x}))::DOUBLE"
_RAW_BLOCKS = f"""g AS (SELECT document_id, page_number, block_no, string_agg(text, ' ' ORDER BY line_no, span_no) AS joined, count(*) FILTER (is_bold) * 2 > count(*) AS is_bold, min(x0) AS bx0, min(y0) AS by0, max(x1) AS bx1, max(y1) AS by1, max(page_width) AS w, max(page_height) AS h FROM raw_spans GROUP BY ALL),
n AS (SELECT document_id, page_number, block_no, is_bold, {_COMMON("font_size")} AS font_size, {_COMMON("font_name")} AS font_name, {_NORMAL.format(t=_CLEAN.format(t="joined"))} AS text, by0 / h < 0.05 OR by0 / h > 0.95 AS outer_band,
  {_CLAMP.format(x="bx0 / w")} AS x0, {_CLAMP.format(x="by0 / h")} AS y0, {_CLAMP.format(x="bx1 / w")} AS x1, {_CLAMP.format(x="by1 / h")} AS y1 FROM g),
lv AS (SELECT *, {O.LEVEL} AS by_words, {O.STRUCTURE} FROM n WHERE text <> ''),
raw_blocks AS (SELECT *, coalesce(by_words, CASE WHEN is_bold AND font_size >= 14 THEN 1 WHEN is_bold AND font_size >= 12 THEN 2 WHEN is_bold AND font_size >= 11 THEN 3 END) AS level,
  CASE WHEN coalesce(by_words, CASE WHEN is_bold AND font_size >= 11 THEN 3 END) IS NOT NULL THEN 'heading' WHEN regexp_matches(trim(text), '^[•●○\\-–—]') THEN 'bullet' ELSE 'body' END AS kind,
  outer_band OR regexp_matches(trim(text), '(?i)^INTERNATIONAL MONETARY FUND$|^QATAR$|^\\d{{1,3}}$|^IMF Country Report') AS running FROM lv)"""
SQL["text_blocks"] = f"""WITH {cte('raw_spans')}, {_RAW_BLOCKS} SELECT page_number, block_no, text, font_size, font_name, is_bold, level AS heading_level, kind AS text_type, paragraph AS paragraph_number, running AS is_header_footer, round(x0, 4) AS x0, round(y1, 4) AS y1 FROM raw_blocks"""
_MERGED = r"""before AS (SELECT *, lag(text) OVER w AS p_text, lag(kind) OVER w AS p_kind, lag(font_size) OVER w AS p_size, lag(y1) OVER w AS p_y1 FROM raw_blocks WHERE NOT running WINDOW w AS (PARTITION BY document_id, page_number ORDER BY block_no)),
joins AS (SELECT *, coalesce(p_kind <> 'heading' AND kind <> 'heading' AND abs(p_size - font_size) <= 0.5 AND NOT regexp_matches(rtrim(p_text), '[.!?:]$') AND (NOT regexp_matches(ltrim(text), '^\p{Lu}') OR (upper(substr(ltrim(text), 1, 3)) = substr(ltrim(text), 1, 3) AND lower(substr(ltrim(text), 1, 3)) <> substr(ltrim(text), 1, 3))) AND paragraph IS NULL AND y0 - p_y1 <= 0.03, false) AS j FROM before),
runs AS (SELECT *, sum((NOT j)::INT) OVER (PARTITION BY document_id, page_number ORDER BY block_no) AS run FROM joins),
paired AS (SELECT *, (row_number() OVER (PARTITION BY document_id, page_number, run ORDER BY block_no) - 1) // 2 AS pair FROM runs),
merged AS (SELECT document_id, page_number, min(block_no) AS block_no, string_agg(text, ' ' ORDER BY block_no) AS content, arg_min(kind, block_no) AS kind, arg_min(level, block_no) AS level, arg_min(paragraph, block_no) AS paragraph FROM paired GROUP BY document_id, page_number, run, pair),
text_rows AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY block_no) - 1 AS pos FROM merged)"""


def _id(modality: str, hashed: str) -> str:
    return O.BLOCK_ID.format(d="document_id", p="page_number", m=f"'{modality}'", t=hashed, o="pos")


SQL["text_to_blocks"] = f"""WITH {cte('raw_spans')}, {_RAW_BLOCKS}, {_MERGED} SELECT {_id("TEXT", "content")} AS block_id, page_number, pos AS position_in_section, content, kind AS text_type, level AS heading_level, paragraph AS paragraph_number, {O.REFERS.replace("text,", "content,")} AS has_cross_references, {O.SECTION.format(p="page_number")} AS section, '[' || {O.SECTION.format(p="page_number")} || CASE WHEN paragraph > 0 THEN ', Para ' || paragraph ELSE ', Page ' || page_number END || ']' AS citation_section FROM text_rows"""
_GRID_ROWS = """grid_lines AS (SELECT document_id, page_number, table_no, r, '| ' || string_agg(coalesce(cell, ''), ' | ' ORDER BY c) || ' |' AS md, string_agg(coalesce(cell, ''), chr(9) ORDER BY c) AS tsv, '|' || string_agg('---', '|') || '|' AS rule FROM raw_cells GROUP BY ALL),
grid_texts AS (SELECT document_id, page_number, table_no, string_agg(CASE WHEN r = 0 THEN md || chr(10) || rule ELSE md END, chr(10) ORDER BY r) AS markdown, string_agg(tsv, chr(10) ORDER BY r) AS tsv FROM grid_lines GROUP BY ALL),
table_rows AS (SELECT t.*, coalesce(trim(title), '') AS named, coalesce(markdown, '') AS markdown, coalesce(tsv, '') AS tsv, row_number() OVER (PARTITION BY document_id, page_number ORDER BY table_no) - 1 AS pos FROM raw_tables t LEFT JOIN grid_texts USING (document_id, page_number, table_no)),
table_blocks AS (SELECT *, CASE WHEN named <> '' AND markdown <> '' THEN named || chr(10) || chr(10) || markdown ELSE named || markdown END AS content, coalesce(nullif(named, ''), nullif(tsv, ''), 'table_' || page_number || '_' || table_no) AS hashed FROM table_rows)"""
SQL["table_to_blocks"] = rf"""WITH {cte('raw_tables')}, {cte('raw_cells')}, {_GRID_ROWS} SELECT {_id("TABLE", "hashed")} AS block_id, content, 'Table ' || nullif(regexp_extract(named, '(?i)Table\s+(\d+[a-z]?)', 1), '') AS table_id, nullif(regexp_extract(named, '\(([^)]+)\)\s*$', 1), '') AS units,
 coalesce((SELECT string_agg(DISTINCT m, ',' ORDER BY m) FROM (SELECT unnest(regexp_extract_all(cell, '(\d+/|\*+)', 1)) AS m FROM raw_cells x WHERE x.page_number = b.page_number AND x.table_no = b.table_no)), '') AS refs,
 CASE WHEN coalesce(error, '') <> '' THEN 0.5 ELSE 1.0 END::DOUBLE AS extraction_confidence, coalesce(error, '') AS warnings FROM table_blocks b"""
_FIGURE_ROWS = r"""ocr_rows AS (SELECT *, coalesce((line_no <> lag(line_no) OVER w)::INT, 1) AS fresh FROM raw_words WHERE confidence >= 60 AND trim(text) <> '' WINDOW w AS (PARTITION BY document_id, page_number, image_no ORDER BY word_no)),
ocr_runs AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id, page_number, image_no ORDER BY word_no) AS line FROM ocr_rows),
ocr_texts AS (SELECT document_id, page_number, image_no, line, string_agg(text, ' ' ORDER BY word_no) AS label, sum(confidence) AS c, count(*) AS k FROM ocr_runs GROUP BY ALL),
ocr_labels AS (SELECT document_id, page_number, image_no, list_sort(list_distinct(list(label)))[1:10] AS labels, sum(c) / sum(k) AS sure FROM ocr_texts GROUP BY ALL),
figure_rows AS (SELECT i.*, labels, sure, coalesce(trim(text_above), '') AS title, concat_ws(chr(10), text_above, text_below) AS around, row_number() OVER (PARTITION BY document_id, page_number ORDER BY y0, x0, image_no) - 1 AS pos FROM raw_images i LEFT JOIN ocr_labels USING (document_id, page_number, image_no) WHERE width >= 100 AND height >= 100),
figure_blocks AS (SELECT *, coalesce(nullif(regexp_extract(around, '(?i)(Text\s+Figure\s+\d+)', 1), ''), nullif(regexp_extract(around, '(?i)(Figure\s+\d+[a-z]?)', 1), ''), nullif(regexp_extract(around, '(?i)(Figure\s+[IVX]+)', 1), '')) AS figure_id,
  coalesce(nullif(title, ''), nullif(trim(text_below), ''), 'figure_' || page_number || '_' || (pos + 1)) AS hashed,
  coalesce(nullif(concat_ws(chr(10) || chr(10), nullif(title, ''), nullif(coalesce(trim(text_below), ''), ''), CASE WHEN len(labels) > 0 THEN 'Labels: ' || array_to_string(labels, ', ') END), ''), 'Figure on page ' || page_number) AS content, coalesce(0.8::DOUBLE + 0.2::DOUBLE * sure / 100, 1.0::DOUBLE) AS confidence FROM figure_rows)"""
SQL["figure_to_blocks"] = f"""WITH {cte('raw_images')}, {cte('raw_words')}, {_FIGURE_ROWS} SELECT {_id("FIGURE", "hashed")} AS block_id, content, figure_id, round(confidence, 4) AS confidence FROM figure_blocks"""
_NOTE_ROWS = r"""low_texts AS (SELECT document_id, page_number, block_no, text, CASE WHEN regexp_matches(text, '^\d+/\s*.+$') THEN regexp_extract(text, '^(\d+/)\s*(.+)$', 1) WHEN regexp_matches(text, '(?i)^source') THEN 'source' END AS marker, CASE WHEN regexp_matches(text, '^\d+/\s*.+$') THEN trim(regexp_extract(text, '^(\d+/)\s*(.+)$', 2)) ELSE text END AS note FROM raw_blocks WHERE y0 >= 0.85),
note_rows AS (SELECT *, '[' || marker || '] ' || note AS content, row_number() OVER (PARTITION BY document_id, page_number ORDER BY block_no) - 1 AS pos FROM low_texts WHERE marker IS NOT NULL)"""
SQL["footnote_to_blocks"] = f"""WITH {cte('raw_spans')}, {_RAW_BLOCKS}, {_NOTE_ROWS} SELECT {_id("FOOTNOTE", "note")} AS block_id, content, marker, rtrim(marker, '/') AS normalized_marker, '[Footnote ' || marker || ', Page ' || page_number || ']' AS citation_short, 'Footnote ' || marker || ', Page ' || page_number || ': ' || substr(note, 1, 50) || '...' AS citation_full FROM note_rows"""
SQL["superscript_markers"] = rf"""WITH {cte('raw_spans')} SELECT page_number, trim(text) AS marker, round(x0 / page_width, 4) AS x0 FROM raw_spans WHERE (font_size < 10 OR contains(lower(font_name), 'super')) AND regexp_matches(trim(text), '^\d+$')"""
SQL["ingest_blocks"] = f"""WITH {cte('raw_spans')}, {cte('raw_tables')}, {cte('raw_cells')}, {cte('raw_images')}, {cte('raw_words')}, {_RAW_BLOCKS}, {_MERGED}, {_GRID_ROWS}, {_FIGURE_ROWS}, {_NOTE_ROWS}
SELECT {_id("TEXT", "content")} AS block_id, 'TEXT' AS modality, content, page_number * 100000 + pos AS ord FROM text_rows
UNION ALL SELECT {_id("TABLE", "hashed")}, 'TABLE', content, 1000000000000 + page_number * 100000 + pos FROM table_blocks
UNION ALL SELECT {_id("FIGURE", "hashed")}, 'FIGURE', content, 2000000000000 + page_number * 100000 + pos FROM figure_blocks
UNION ALL SELECT {_id("FOOTNOTE", "note")}, 'FOOTNOTE', content, 3000000000000 + page_number * 100000 + pos FROM note_rows"""
# What stands in the 50 points above a table, within its width.
SQL["table_titles"] = rf"""WITH {cte('raw_tables')}, {cte('raw_spans')}
SELECT t.page_number, t.table_no, coalesce(string_agg(s.text, ' ' ORDER BY block_no, line_no, span_no), '') AS text_above, 'Table ' || nullif(regexp_extract(string_agg(s.text, ' ' ORDER BY block_no, line_no, span_no), '(?i)Table\s+(\d+[a-z]?)', 1), '') AS table_id
FROM raw_tables t LEFT JOIN raw_spans s ON t.document_id = s.document_id AND t.page_number = s.page_number AND s.x0 >= t.tx0 AND s.x1 <= t.tx1 AND s.y0 >= greatest(0, t.ty0 - 50) AND s.y1 <= t.ty0 GROUP BY t.document_id, t.page_number, t.table_no"""
SQL["figure_regions"] = rf"""WITH {cte('raw_spans')}, {cte('raw_images')}, s AS (SELECT *, coalesce(nullif(regexp_extract(text, '(?i)(Text\s+Figure\s+\d+)', 1), ''), nullif(regexp_extract(text, '(?i)(Figure\s+\d+[a-z]?)', 1), ''), nullif(regexp_extract(text, '(?i)(Figure\s+[IVX]+)', 1), '')) AS figure_id FROM raw_spans WHERE contains(text, 'Figure'))
SELECT page_number, figure_id, text AS title, 0.8::DOUBLE AS extraction_confidence, round(least(y1 + 300, page_height * 0.9) / page_height, 4) AS bottom FROM s WHERE figure_id IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM raw_images i WHERE i.document_id = s.document_id AND i.page_number = s.page_number AND NOT (s.x1 / page_width < i.x0 OR i.x1 < s.x0 / page_width OR s.y1 / page_height < i.y0 OR i.y1 < s.y0 / page_height))"""

# --- presentation ---------------------------------------------------------------------

SQL["eval_dashboard"] = f"""{O._EVAL}, c AS (SELECT category, count(*) AS n, count(*) FILTER (passed) AS p FROM e GROUP BY category), m AS (SELECT modality, count(*) AS n FROM (SELECT unnest(string_split(seen, ';')) AS modality FROM specs) GROUP BY modality)
SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(100.0::DOUBLE * count(*) FILTER (passed) / count(*), 4) AS pass_rate,
 (SELECT string_agg(category || ':' || n || ':' || p, ';' ORDER BY category) FROM c) AS categories, (SELECT string_agg(modality || ':' || n, ';' ORDER BY modality) FROM m) AS modalities FROM e"""
_ROW = lambda cells, tag: f"'<tr>' || array_to_string(list_transform({cells}, lambda c: '<{tag}>' || trim(regexp_replace(c, '\\*+', '', 'g')) || '</{tag}>'), '') || '</tr>'"
_TABLE = lambda head, rows: f"'<table><thead>' || {_ROW(head, 'th')} || '</thead><tbody>' || array_to_string(list_transform({rows}, lambda r: {_ROW('r', 'td')}), '') || '</tbody></table>'"
SQL["answer_html"] = rf"""WITH {cte('shown')}, a AS (SELECT *, list_transform(string_split({_strip('text')}, chr(10)), lambda x: trim(x)) AS every FROM shown),
b AS (SELECT *, list_filter(every, lambda x: x <> '') AS ls, regexp_extract_all(text, '\*\*([^*]+)\*\*[:\s]+([^\n*]+)', 1) AS names, regexp_extract_all(text, '\*\*([^*]+)\*\*[:\s]+([^\n*]+)', 2) AS vals, trim(string_split(text, '**')[1]) AS intro FROM a),
c AS (SELECT *, list_filter(list_transform(list_filter(ls, lambda x: contains(x, '|') AND NOT regexp_matches(x, '^[|\-:\s]+$')), lambda x: list_filter(list_transform(string_split(x, '|'), lambda z: trim(z)), lambda z: z <> '')), lambda r: len(r) > 0) AS piped,
  coalesce(list_position(list_transform(ls, lambda x: len(regexp_extract_all(x, '\b20\d{{2}}\b')) >= 3), true), 0) AS y FROM b),
d AS (SELECT *, CASE WHEN y > 0 THEN regexp_extract_all(ls[y], '\b(20\d{{2}})\b', 1) END AS years, list_transform(ls[y + 1 :], lambda x: {{'line': x, 'v': regexp_extract_all(x, '(-?\d+\.?\d*)', 1), 'label': trim(regexp_replace(regexp_extract(x, '^(.*?)\s*-?\d', 1), '\*+', '', 'g'))}}) AS below FROM c),
f AS (SELECT *, list_transform(list_filter(below, lambda r: len(r.v) >= len(years)), lambda r: list_prepend(CASE WHEN length(r.label) < 2 THEN 'Value' ELSE r.label END, r.v[len(r.v) - len(years) + 1 :])) AS yearly, list_filter(every, lambda x: regexp_matches(x, '^[-*\d.]+\s*\**[^:*]+\**[:\s]+.+$')) AS points FROM d),
g AS (SELECT *, trim(array_to_string(list_filter(every, lambda x: NOT regexp_matches(x, '^[-*\d.]+\s*\**[^:*]+\**[:\s]+.+$'))[1:2], chr(10))) AS others FROM f)
SELECT id, CASE WHEN length(text) < 10 THEN text
  WHEN len(regexp_extract_all(text, '\|')) >= 4 AND len(piped) >= 2 THEN {_TABLE('piped[1]', 'piped[2:]')}
  WHEN len(names) >= 2 THEN CASE WHEN length(intro) > 15 THEN '<p>' || intro || '</p>' ELSE '' END || {_TABLE("['Indicator', 'Value']", "list_transform(range(1, len(names) + 1), lambda i: [trim(names[i]), trim(vals[i])])")}
  WHEN (lower(intent) = 'table_lookup' OR contains(lower(substr(text, 1, 100)), 'table')) AND y > 0 AND len(yearly) > 0 THEN array_to_string(list_concat(list_transform(ls[1 : y - 1], lambda x: '<p>' || x || '</p>'), list_transform(list_filter(below, lambda r: len(r.v) < len(years)), lambda r: '<p><strong>' || r.line || '</strong></p>')), chr(10)) || chr(10) || {_TABLE("list_prepend('Indicator', years)", "yearly")}
  WHEN len(points) >= 3 THEN CASE WHEN length(others) > 10 THEN '<p>' || others || '</p>' ELSE '' END || {_TABLE("['Item', 'Details']", "list_transform(points, lambda x: [trim(regexp_extract(x, '^[-*" + chr(92) + "d.]+" + chr(92) + "s*" + chr(92) + "**([^:*]+)" + chr(92) + "**[:" + chr(92) + "s]+(.+)$', 1)), trim(regexp_extract(x, '^[-*" + chr(92) + "d.]+" + chr(92) + "s*" + chr(92) + "**([^:*]+)" + chr(92) + "**[:" + chr(92) + "s]+(.+)$', 2))])")}
  ELSE text END AS html FROM g"""
