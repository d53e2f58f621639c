"""DuckDB SQL for the ``opN_*`` queries that SQL can express, with patterns and lists of its own."""

from __future__ import annotations

#: Operator 7. Ranks stand in the same order as the operator's: by size class, slot, size, id and digest.
OP7 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, substr(md5(coalesce(text, '')), 1, 16) AS tie FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
lines AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(size) FROM d) - (sum(2.0::DOUBLE * source_size) OVER up - 2.0::DOUBLE * source_size))
            / (sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS line
  FROM per WINDOW up AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
goal AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, greatest(0.0::DOUBLE, (SELECT max(line) FROM lines) * w)) AS target,
         ('0x' || substr(md5('mix:' || CASE WHEN source IS NULL THEN 'n' ELSE 's' END || ':' || coalesce(source, '')), 1, 4))::BIGINT / 65536.0::DOUBLE AS u
  FROM lines),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.u,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)) * 16 + ((d.size >> greatest(length(bin(d.size)) - 5, 0)) & 15), substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':' || tie), 1, 2), d.size, d.doc_id NULLS FIRST, tie) AS k
  FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
taken AS (SELECT *, least(floor(u + rate * k) - floor(u + rate * (k - 1)), 2)::BIGINT AS copies FROM placed)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM taken
"""

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Operator 2, by trying every run of words that begins at a template's word. ``l``: words of the longest run; ``tell``: words that must be there.
OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, doc_id, {_WORDS.format("text")} AS w FROM d),
phrases(label, p) AS (VALUES ('gpl', ['gnu', 'general', 'public', 'license']), ('apache', ['apache', 'license']), ('cc-by', ['cc', 'by']), ('mit', ['mit', 'license'])),
hits AS (SELECT r, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS pos FROM words, phrases WHERE len(list_intersect(w, p)) = len(p)),
base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base FROM hits GROUP BY r),
wording(label, text) AS (VALUES
  ('gpl', 'this work is licensed under the gnu general public license version 3'),
  ('gpl', 'you can redistribute it and or modify it under the terms of the gnu general public license'),
  ('lgpl', 'under the terms of the gnu lesser general public license'),
  ('agpl', 'licensed under the gnu affero general public license'),
  ('apache', 'licensed under the apache license version 2 0'),
  ('mit', 'released under the mit license'),
  ('mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files'),
  ('bsd', 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met'),
  ('mpl', 'this source code form is subject to the terms of the mozilla public license'),
  ('isc', 'permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted'),
  ('cc-by', 'licensed under cc by 4 0'),
  ('cc-by-nc', 'licensed under cc by nc 4 0'),
  ('cc-by-sa', 'licensed under cc by sa 4 0'),
  ('cc0', 'the person has waived all copyright and related or neighboring rights to this work'),
  ('unlicense', 'this is free and unencumbered software released into the public domain'),
  ('reserved', 'copyright all rights reserved no part may be reproduced without permission')),
t AS (
  SELECT row_number() OVER () AS t, label, list_distinct(string_split(text, ' ')) AS ws, len(string_split(text, ' ')) + greatest(2, len(string_split(text, ' ')) // 4) AS l,
         list_filter(list_distinct(string_split(text, ' ')), lambda x: x IN ('affero', 'apache', 'by', 'cc', 'general', 'gnu', 'lesser', 'mit', 'mozilla', 'nc', 'sa')) AS tell FROM wording),
near AS (SELECT r, t, label, ws, l, tell, w FROM words, t WHERE len(list_intersect(list_distinct(w), ws)) >= ceil(0.8 * len(ws))),
runs AS (SELECT r, t, label, ws, tell, unnest(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains(ws, w[i])), lambda i: list_intersect(list_distinct(w[i : i + l - 1]), ws))) AS held FROM near),
found AS (SELECT r, label, len(held) / len(ws)::DOUBLE AS share FROM runs WHERE len(held) >= ceil(0.8 * len(ws)) AND len(list_intersect(held, tell)) = len(tell)),
more AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM words LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_PATTERNS = (("assign", _ASSIGN, 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), ("entropy", "[A-Za-z0-9+/_=-]+", 0, 20))
_RULES = " UNION ALL ".join(
    f"SELECT r, {k} AS k, '{kind}' AS kind, regexp_split_to_array(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {g}) AS gs, {n} AS least FROM d WHERE regexp_matches(text, '{p}')"
    for k, (kind, p, g, n) in enumerate(_PATTERNS)
)

#: Operator 6: places from the text between matches, entropy of each window afresh.
OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({_RULES}),
one AS (SELECT r, k, kind, gaps, ms, gs, least, unnest(range(1, len(ms) + 1)) AS i FROM hits),
long AS (SELECT * FROM one WHERE len(gs[i]) >= least),
spans AS (
  SELECT r, k, kind, ms[i] AS m, (coalesce(list_sum(list_transform(gaps[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: len(x))), 0))::BIGINT AS s FROM long),
asked AS (
  SELECT *, kind || ':' || s || ':' || (s + len(m)) AS text,
         CASE WHEN regexp_matches(m, '^[0-9_=+/-]+$') THEN 3.05
              WHEN regexp_matches(m, '^[0-9a-f]+$') OR regexp_matches(m, '^[0-9A-F]+$') THEN 2.93
              WHEN regexp_matches(m, '^[A-Za-z+/]+={{1,2}}$') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') THEN 3.73
              WHEN regexp_matches(m, '^[a-z]+$') OR regexp_matches(m, '^[A-Z]+$') OR regexp_matches(m, '^[A-Z][a-z]+$') OR regexp_matches(m, '^[A-Za-z]+([-_/=+]+[A-Za-z]*)+$') THEN 3.8
              ELSE 3.73 END::DOUBLE AS bits
  FROM spans),
kept AS (
  SELECT * FROM asked
  WHERE k < 3 OR (NOT regexp_matches(m, '(?i)example|sample|placeholder|dummy|changeme|xxxx|1234567890|abcdefghij|^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') AND
    list_max(list_transform(range(1, len(m) - 18), lambda i: list_entropy(string_split(substr(m, i, 20), '')))) >= bits)),
per AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(text, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(text, ',' ORDER BY s, k) AS spans
  FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (r)
"""

#: Operator 4: all sets that share a shingle are compared; components by reachability among classes of equal sets.
OP4 = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END)) AS g FROM w),
k AS (SELECT *, CASE WHEN len(g) > 0 THEN md5(array_to_string(g, chr(10))) END AS c FROM s),
classes AS (SELECT c, any_value(g) AS g, any_value(len(g)) AS n, min(doc_id) AS least FROM k WHERE c IS NOT NULL GROUP BY c),
each AS (SELECT c, n, unnest(g) AS x FROM classes),
pairs AS (SELECT a.c AS a, b.c AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS shared FROM each a JOIN each b ON a.x = b.x AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (n + m - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(c, least) AS (SELECT c, least FROM classes UNION SELECT l.b, reach.least FROM reach JOIN both_ways l ON l.a = reach.c),
low AS (SELECT c, min(least) AS component_id FROM reach GROUP BY c)
SELECT doc_id, len(g)::BIGINT AS n_shingles, CASE WHEN k.c IS NULL THEN doc_id ELSE component_id END AS component_id FROM k LEFT JOIN low ON k.c = low.c
"""

#: Operator 9: every pair of vectors.
OP9 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (
  SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
  WHERE coalesce(len(e), 0) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM n a JOIN n b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach(r, least) AS (SELECT r, vec_id FROM v UNION SELECT l.b, reach.least FROM reach JOIN links l ON l.a = reach.r),
low AS (SELECT r, min(least) AS component_id FROM reach GROUP BY r),
counted AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN low USING (r) LEFT JOIN counted USING (r)
"""

_KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), ("card", r"[0-9](?:[\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
_FOUND = " UNION ALL ".join(f"SELECT r, {k} AS k, '{kind}' AS kind, regexp_split_to_array(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS ms FROM d WHERE regexp_matches(text, '{p}')" for k, (kind, p) in enumerate((*_KINDS, ("word", r"\S*[0-9@]\S*"))))
_AT = "(coalesce(list_sum(list_transform(gaps[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: len(x))), 0))::BIGINT"
_DIGITS = "list_transform(list_reverse(string_split(regexp_replace(m, '[^0-9]', '', 'g'), '')), lambda x: x::INT)"
_LUHN = "list_sum(list_transform(range(1, len(ds) + 1), lambda i: CASE WHEN i % 2 = 1 THEN ds[i] WHEN ds[i] > 4 THEN 2 * ds[i] - 9 ELSE 2 * ds[i] END)) % 10 = 0"
_SHORT = "CASE WHEN length({x}) <= 200 THEN lower({x}) ELSE '#' || length({x}) || ':' || md5({x}) END"


def _round(k: int) -> str:
    """One round: contexts by their instances' confidence, then instances by their contexts'."""
    return f"""c{k} AS (SELECT context, sum(n * conf) / (sum(n) + 1) AS confidence FROM e{k} GROUP BY context HAVING sum(n * conf) / (sum(n) + 1) >= 0.7 AND count(*) FILTER (conf >= 0.7) >= 3),
o{k} AS (SELECT instance, 1 - exp(sum(ln(greatest(1e-9, 1 - confidence)))) AS p FROM e{k} JOIN c{k} USING (context) GROUP BY instance),
e{k + 1} AS (SELECT context, instance, n, seed, CASE WHEN seed THEN 1.0::DOUBLE ELSE coalesce(p, 0.0::DOUBLE) END AS conf FROM e{k} LEFT JOIN o{k} USING (instance))"""


#: Operator 3: base spans by their patterns; contexts scored in three rounds.
OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({_FOUND}),
one AS (SELECT r, k, kind, ms[i] AS m, {_AT} AS s FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM hits)),
spans AS (SELECT *, s + len(m) AS e, {_DIGITS} AS ds FROM one),
base AS (SELECT r, k, kind, m, s, e FROM spans WHERE k = 0 OR (k = 1 AND len(list_filter(string_split(m, '.'), lambda x: x::HUGEINT > 255)) = 0) OR (k = 2 AND len(ds) BETWEEN 12 AND 19 AND {_LUHN}) OR (k = 3 AND len(ds) BETWEEN 9 AND 15)),
bare AS (SELECT r, s AS ws, e AS we, s + length(m) - length(ltrim(m, '"''()[]{{}}<>,;:!?.*#$%&|')) AS s, trim(m, '"''()[]{{}}<>,;:!?.*#$%&|') AS m FROM spans WHERE k = 4),
others AS (SELECT r, s, s + length(m) AS e, m FROM bare w WHERE regexp_matches(m, '[0-9@]') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.s < w.we AND b.e > w.ws)),
placed AS (SELECT r, s, e, m, true AS seed FROM base UNION ALL SELECT r, s, e, m, false FROM others),
before AS (SELECT p.*, ' ' || substr(d.text, 1, p.s::BIGINT) AS b FROM placed p JOIN d USING (r)),
cut AS (SELECT *, regexp_extract(b, '(\S+)?\s+(\S+)\s*$', 1) AS w1, regexp_extract(b, '(\S+)?\s+(\S+)\s*$', 2) AS w2 FROM before),
seen AS (SELECT r, s, e, seed, {_SHORT.format(x="m")} AS instance, CASE WHEN w2 = '' THEN NULL WHEN right(w2, 1) IN (':', '=', '#') THEN {_SHORT.format(x="w2")} WHEN w1 <> '' THEN {_SHORT.format(x="w1")} || ' ' || {_SHORT.format(x="w2")} END AS context FROM cut),
e0 AS (SELECT context, instance, count(*) AS n, bool_or(seed) AS seed, bool_or(seed)::INT::DOUBLE AS conf FROM seen WHERE context IS NOT NULL GROUP BY context, instance),
{_round(0)}, {_round(1)}, {_round(2)},
every AS (SELECT r, k, kind, s, e FROM base UNION ALL SELECT r, 4, 'context', s, e FROM seen WHERE NOT seed AND context IN (SELECT context FROM c2)),
per AS (
  SELECT r, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM every GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (r)
"""

SQL = {"op2_license_scan": OP2, "op3_personal_data": OP3, "op4_ngram_jaccard": OP4, "op6_secret_scan": OP6, "op7_source_mixing": OP7, "op9_near_vectors": OP9}
