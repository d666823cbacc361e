"""SQL, for DuckDB, of the registered queries."""

from __future__ import annotations

from loomgraph.functions.text import NOISE_ENTITIES, STOP_WORDS
from loomgraph.plans.queries import MERGES, PARTS, SEARCH


def _cid(kind: str, name: str) -> str:
    return f"{kind} || ':' || regexp_replace(regexp_replace(lower({name}), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')"


def _tokens(text: str) -> str:
    return f"CAST(ceil(length({text}) / 4.0) AS BIGINT)"


SQL = {}

SQL["canonical_ids"] = f"""
SELECT kind, name, {_cid('kind', 'name')} AS id FROM (
  SELECT 'person' AS kind, c_name AS name FROM customer UNION ALL SELECT 'entity', p_name FROM part UNION ALL SELECT 'entity', n_name FROM nation)
"""
SQL["token_estimate"] = f"SELECT doc_id, {_tokens('text')} AS tokens FROM documents"
SQL["cost_estimate"] = f"""
SELECT chunks, input_tokens, output_tokens, round(input_tokens / 1e6 * 0.04 + output_tokens / 1e6 * 0.15, 6) AS estimated_cost, 'google/gemini-2.0-flash-lite-001' AS model
FROM (SELECT count(*) AS chunks, CAST(sum({_tokens('text')}) + count(*) * 300 AS BIGINT) AS input_tokens, count(*) * 500 AS output_tokens FROM documents)
"""
SQL["content_hash_skip"] = """
WITH h AS (SELECT doc_id, sha256(text) AS content_hash FROM documents)
SELECT * FROM h WHERE content_hash NOT IN (SELECT content_hash FROM h WHERE doc_id IN (SELECT doc_id FROM labels))
"""

_CHAT = """
chat AS (
  SELECT conv_id, turn, role, strftime(to_timestamp(1704067200 + turn * 120 + (turn // 4) * 1800) AT TIME ZONE 'UTC', '%-m/%-d/%y, %-H:%M') || ' - ' || role || ': ' || text AS line
  FROM conversations
)"""
SQL["chat_detect"] = rf"""
WITH {_CHAT}, files AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn, line) AS content FROM chat GROUP BY conv_id),
lines AS (SELECT conv_id, unnest(string_split(content, chr(10))[1:20]) AS line FROM files)
SELECT 'chats/' || conv_id || '.txt' AS path, count(*) FILTER (regexp_matches(line, '^\[?\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}},?\s+\d{{1,2}}:\d{{2}}')) >= 3 AS is_chat
FROM lines GROUP BY conv_id
"""
SQL["chat_participants"] = """
SELECT 'chats/' || conv_id || '.txt' AS path, CAST(sum(n) AS BIGINT) AS messages, string_agg(role, ', ' ORDER BY first) AS participants
FROM (SELECT conv_id, role, min(turn) AS first, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id
"""
SQL["chat_chunks"] = rf"""
WITH RECURSIVE {_CHAT}, files AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn, line) AS content FROM chat GROUP BY conv_id),
detected AS (
  SELECT conv_id FROM (SELECT conv_id, unnest(string_split(content, chr(10))[1:20]) AS line FROM files)
  GROUP BY conv_id HAVING count(*) FILTER (regexp_matches(line, '^\d{{1,2}}/\d{{1,2}}/\d{{2}}, \d{{1,2}}:\d{{2}}')) >= 3
),
m AS (
  SELECT conv_id, role, line, turn * 120 + (turn // 4) * 1800 AS t, length(line) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, line) AS i
  FROM chat WHERE conv_id IN (SELECT conv_id FROM detected)
),
walk AS (
  SELECT conv_id, i, t, 1 AS n, size, 0 AS segment, size AS whole FROM m WHERE i = 1
  UNION ALL
  SELECT m.conv_id, m.i, m.t, CASE WHEN cut THEN 1 ELSE w.n + 1 END, m.size, w.segment + CAST(cut AS INT), CASE WHEN cut THEN m.size ELSE w.whole + 1 + m.size END
  FROM (SELECT w.*, x.cut FROM walk w JOIN m ON m.conv_id = w.conv_id AND m.i = w.i + 1, LATERAL (SELECT (m.t - w.t > 600 AND w.n > 3) OR ceil(w.whole / 4.0) > 200 AS cut) x) w
  JOIN m ON m.conv_id = w.conv_id AND m.i = w.i + 1
),
sized AS (SELECT conv_id, segment, sum(size) + count(*) - 1 AS total FROM walk GROUP BY ALL),
pack AS (
  SELECT w.conv_id, w.i, w.segment, 0 AS sub, ceil(w.size / 4.0) AS tokens FROM walk w WHERE w.i = (SELECT min(i) FROM walk v WHERE v.conv_id = w.conv_id AND v.segment = w.segment)
  UNION ALL
  SELECT w.conv_id, w.i, w.segment,
    CASE WHEN ceil(s.total / 4.0) > 200 AND p.tokens + ceil(w.size / 4.0) > 200 THEN p.sub + 1 ELSE p.sub END,
    CASE WHEN p.tokens + ceil(w.size / 4.0) > 200 THEN 0 ELSE p.tokens END + ceil(w.size / 4.0)
  FROM pack p JOIN walk w ON w.conv_id = p.conv_id AND w.segment = p.segment AND w.i = p.i + 1 JOIN sized s ON s.conv_id = p.conv_id AND s.segment = p.segment
),
grouped AS (
  SELECT p.conv_id, p.segment, p.sub, string_agg(m.line, chr(10) ORDER BY m.i) AS text FROM pack p JOIN m USING (conv_id, i) GROUP BY ALL
),
people AS (
  SELECT conv_id, segment, sub, string_agg(role, ', ' ORDER BY first) AS who
  FROM (SELECT p.conv_id, p.segment, p.sub, m.role, min(m.i) AS first FROM pack p JOIN m USING (conv_id, i) GROUP BY ALL) GROUP BY ALL
),
whole AS (SELECT conv_id, regexp_replace(content, '^\s+|\s+$', '', 'g') AS text FROM files WHERE conv_id NOT IN (SELECT conv_id FROM detected))
SELECT 'chats/' || conv_id || '.txt' AS source, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY segment, sub) - 1 AS INT) AS chunk_index,
  CAST(count(*) OVER (PARTITION BY conv_id) AS INT) AS total_chunks, 'Conversation: ' || who AS heading, sha256(text) AS content_hash, true AS is_chat
FROM grouped JOIN people USING (conv_id, segment, sub)
UNION ALL SELECT 'chats/' || conv_id || '.txt', 0, 1, '', sha256(text), false FROM whole
"""
SQL["gap_segments"] = """
WITH RECURSIVE m AS (SELECT user_id, (epoch_us(ts) // 1000) AS t, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS i FROM events),
walk AS (
  SELECT user_id, i, t, 1 AS n, 0 AS segment FROM m WHERE i = 1
  UNION ALL
  SELECT m.user_id, m.i, m.t, CASE WHEN m.t - w.t > 21600000 AND w.n > 3 THEN 1 ELSE w.n + 1 END, w.segment + CAST(m.t - w.t > 21600000 AND w.n > 3 AS INT)
  FROM walk w JOIN m ON m.user_id = w.user_id AND m.i = w.i + 1
)
SELECT user_id, segment, count(*) AS messages, min(t) AS first_ms FROM walk GROUP BY user_id, segment
"""
_CSV_LINE = "concat_ws(',', p_partkey, p_name, p_brand, p_type, p_size)"
SQL["csv_chunks"] = f"""
WITH r AS (SELECT p_partkey // 500 AS f, {_CSV_LINE} AS line, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) AS i FROM part),
h AS (SELECT 'p_partkey,p_name,p_brand,p_type,p_size' AS header),
per AS (SELECT f, greatest(1, CAST(floor((200 - {_tokens('header')}) / greatest(1, {_tokens('line')})) AS BIGINT)) AS n FROM r, h WHERE i = 1),
b AS (SELECT f, (i - 1) // n AS k, min(i) AS a, max(i) AS z, string_agg(line, chr(10) ORDER BY i) AS rows FROM r JOIN per USING (f) GROUP BY ALL)
SELECT 'parts/' || f || '.csv' AS source, CAST(k AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY f) AS INT) AS total_chunks, 'rows ' || a || '-' || z AS heading, sha256(header || chr(10) || rows) AS content_hash
FROM b, h
"""
SQL["json_chunks"] = """
WITH r AS (
  SELECT n_regionkey AS f, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i,
    '  {' || chr(10) || '    "n_nationkey": ' || n_nationkey || ',' || chr(10) || '    "n_name": "' || n_name || '"' || chr(10) || '  }' AS item FROM nation
), per AS (SELECT f, greatest(1, CAST(floor(40 / greatest(1, ceil((length(item) - 8) / 4.0))) AS BIGINT)) AS n FROM r WHERE i = 0),
b AS (SELECT f, i // n AS k, min(i) AS a, max(i) AS z, string_agg(item, ',' || chr(10) ORDER BY i) AS items FROM r JOIN per USING (f) GROUP BY ALL)
SELECT 'nations/' || f || '.json' AS source, CAST(k AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY f) AS INT) AS total_chunks, 'items ' || a || '-' || z AS heading, '[' || chr(10) || items || chr(10) || ']' AS text
FROM b
"""
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SQL["markdown_sections"] = f"""
WITH s AS (
  SELECT doc_id, 0 AS k, '' AS heading, 'About ' || source AS text FROM documents
  UNION ALL SELECT doc_id, 1, 'Text of ' || doc_id, {_TRIM.format('text')} FROM documents
  UNION ALL SELECT doc_id, 2, 'Language', '### Code' || chr(10) || lang FROM documents
)
SELECT 'docs/' || doc_id || '.md' AS source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS chunk_index,
  CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total_chunks, heading, sha256(text) AS content_hash
FROM s WHERE text <> ''
"""


def _packed(limit: int, source: str = "documents") -> str:
    return rf"""
lines AS (SELECT doc_id, {_TRIM.format('line')} AS p, pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {source})),
p AS (SELECT doc_id, p, length(p) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM lines WHERE p <> ''),
walk AS (
  SELECT doc_id, i, i AS a, CAST(ceil(size / 4.0) AS BIGINT) AS tokens, size, 0 AS before, 0 AS chunk, CAST(NULL AS BIGINT) AS emitted_from FROM p WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN w.tokens + ceil(p.size / 4.0) > {limit} THEN greatest(p.i - 2, w.a) ELSE w.a END,
    CAST(CASE WHEN w.tokens + ceil(p.size / 4.0) > {limit} THEN ceil((w.size + CASE WHEN p.i - w.a >= 2 THEN w.before + 2 ELSE 0 END) / 4.0) ELSE w.tokens END + ceil(p.size / 4.0) AS BIGINT),
    p.size, w.size, w.chunk + CAST(w.tokens + ceil(p.size / 4.0) > {limit} AS INT), CASE WHEN w.tokens + ceil(p.size / 4.0) > {limit} THEN w.a END
  FROM walk w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1
),
spans AS (
  SELECT doc_id, chunk - 1 AS k, emitted_from AS a, i - 1 AS z FROM walk WHERE emitted_from IS NOT NULL
  UNION ALL SELECT doc_id, max(chunk), max(a), max(i) FROM walk GROUP BY doc_id
),
texts AS (SELECT s.doc_id, k, string_agg(p, chr(10) || chr(10) ORDER BY i) AS text FROM spans s JOIN p ON p.doc_id = s.doc_id AND p.i BETWEEN s.a AND s.z GROUP BY s.doc_id, k),
kept AS (SELECT * FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY k) AS prior, max(k) OVER (PARTITION BY doc_id) AS last FROM texts) WHERE NOT (k = last AND text IS NOT DISTINCT FROM prior))"""


SQL["paragraph_chunks"] = f"""
WITH RECURSIVE {_packed(200)}
SELECT 'docs/' || doc_id || '.txt' AS source, CAST(k AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total_chunks, sha256(text) AS content_hash FROM kept
"""
SQL["json_fallback"] = SQL["paragraph_chunks"]
SQL["chat_fallback"] = f"""
WITH RECURSIVE {_packed(200, "(SELECT doc_id, repeat('1/2/24, 10:00' || chr(10), 3) || text AS text FROM documents)")}
SELECT 'docs/' || doc_id || '.txt' AS source, CAST(k AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total_chunks, sha256(text) AS content_hash FROM kept
"""
_PLAIN = "(SELECT doc_id, replace(text, '#', '') AS text FROM documents)"
SQL["section_parts"] = f"""
WITH RECURSIVE {_packed(200, _PLAIN)},
whole AS (SELECT doc_id, {_TRIM.format("replace(text, chr(10), chr(10) || chr(10))")} AS text FROM {_PLAIN}),
parts AS (
  SELECT doc_id, -1 AS k, 'About ' || source AS text FROM documents
  UNION ALL SELECT doc_id, 0, text FROM whole WHERE text <> '' AND {_tokens('text')} <= 200
  UNION ALL SELECT doc_id, k, text FROM kept WHERE doc_id IN (SELECT doc_id FROM whole WHERE {_tokens('text')} > 200)
)
SELECT 'docs/' || doc_id || '.md' AS source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total_chunks,
  CASE WHEN k < 0 THEN '' ELSE 'Text of ' || doc_id END AS heading, sha256(text) AS content_hash FROM parts
"""
SQL["chat_times"] = "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN (epoch_us(ts) // 1000000) * 1000 END AS millis FROM events"
SQL["chunk_prompts"] = """
SELECT doc_id, sha256(CASE WHEN doc_id % 4 > 0 THEN '[Context: part ' || doc_id % 4 || ']' || chr(10) ELSE '' END || '[Source: docs/' || doc_id || '.txt]' || chr(10) || chr(10) || text) AS prompt FROM documents
"""
SQL["replayed_answers"] = """
SELECT doc_id, CASE WHEN ok THEN 'E' || left(h, 3) END AS entity, CASE WHEN ok THEN 'About ' || left(h, 8) END AS fact, CASE WHEN coalesce(left(h, 1) < 'e', false) THEN length(text) ELSE 0 END AS usage_tokens, NOT ok AS failed
FROM (SELECT *, coalesce(left(h, 1) < 'c', false) AS ok FROM (SELECT doc_id, text, sha256(text) AS h FROM documents))
"""
SQL["processed_rows"] = "SELECT sha256(text) AS content_hash, 'now' AS extracted_at, max(length(text)) AS tokens FROM documents WHERE left(sha256(text), 1) < 'c' GROUP BY 1"
SQL["document_nodes"] = """
SELECT 'document:' || left(sha256('docs/' || doc_id || '.txt'), 12) AS id, 'document' AS type, 'docs/' || doc_id || '.txt' AS path, doc_id || '.txt' AS filename, strlen(replace(text, chr(10), chr(10) || chr(10))) AS size, 'now' AS "ingestedAt" FROM documents
"""
SQL["upserted_nodes"] = """
WITH p AS (SELECT c_custkey AS k, 'customer:' || c_custkey AS id, c_name AS name, c_mktsegment AS role FROM customer),
n AS (
  SELECT CASE WHEN k % 5 = 0 THEN id || '-new' ELSE id END AS id, CASE WHEN k % 2 = 0 THEN lower(role) END AS role, k % 3 = 0 AS nameless, CASE WHEN k % 3 = 0 THEN CAST(k AS VARCHAR) END AS odd
  FROM p WHERE k % 2 = 0 OR k % 3 = 0
)
SELECT coalesce(p.id, n.id) AS id, CASE WHEN NOT coalesce(n.nameless, false) THEN p.name END AS name, coalesce(n.role, p.role) AS role, CASE WHEN n.id IS NOT NULL THEN 'told again' END AS summary, n.odd
FROM p FULL JOIN n ON n.id = p.id
"""
SQL["node_lookup"] = "SELECT 'supplier:' || s_suppkey AS id, 'entity' AS type, s_name AS name FROM supplier WHERE s_suppkey = 3"
SQL["chunk_totals"] = f"""
WITH RECURSIVE {_packed(6000)}
SELECT 'docs/' || doc_id || '.txt' AS source, count(*) AS chunks, CAST(sum({_tokens('text')}) AS BIGINT) AS tokens FROM kept GROUP BY doc_id
"""
SQL["prescan_sample"] = """
WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n, text FROM documents),
wanted AS (SELECT DISTINCT unnest([0, n - 1] || [least(i * (n // 7), n - 1) for i in range(1, 7)]) AS position FROM r)
SELECT position, left(text, 3000) AS text FROM r WHERE position IN (SELECT position FROM wanted)
"""

_EXT = f"""
every_item AS (
  SELECT l_orderkey AS o, l_orderkey * 10 + l_linenumber AS ord, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p_name, p_brand, p_type) AS i, p_name, p_brand, p_type, c_name, c_mktsegment, o_orderpriority,
    {_cid("'entity'", 'p_name')} AS eid, {_cid("'person'", 'c_name')} AS pid
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
),
items AS (SELECT * FROM every_item WHERE i <= 8),
entities AS (SELECT eid, arg_min(p_name, (ord, i)) AS name, arg_min(p_type, (ord, i)) AS type, count(*) AS mentions, min(o) AS first_order FROM items GROUP BY eid),
texts AS (
  SELECT o, kind, text, {_cid('kind', 'left(text, 60)')} AS id FROM (
    SELECT o, 'fact' AS kind, c_name || ' ordered the part named ' || p_name || ' of ' || p_brand AS text FROM items WHERE i = 1
    UNION ALL SELECT o, 'decision', 'Order ' || o || ' ships with priority ' || o_orderpriority FROM items WHERE i = 1
    UNION ALL SELECT o, 'preference', c_name || ' prefers ' || p_brand FROM items WHERE i = 1)
),
merged_texts AS (SELECT id, kind, arg_max(text, o) AS text, min(o) AS first_order FROM texts GROUP BY id, kind)"""
SQL["alias_index"] = f"""
WITH {_EXT},
direct AS (
  SELECT alias, arg_max(node_type, place) AS node_type FROM (
    SELECT lower(p_name) AS alias, 'entity' AS node_type, (o, 0, i) AS place FROM every_item UNION ALL SELECT lower(c_name), 'person', (o, 1, 0) FROM every_item WHERE i = 1) GROUP BY alias
),
also AS (SELECT lower(p_brand) AS alias, arg_min(lower(p_name), (o, i)) AS canonical FROM every_item GROUP BY 1)
SELECT alias, alias AS canonical, node_type FROM direct
UNION ALL SELECT alias, canonical, 'entity' FROM also WHERE alias NOT IN (SELECT alias FROM direct)
"""
SQL["entity_merge"] = f"""
WITH {_EXT},
al AS (SELECT eid, string_agg(p_brand, ',' ORDER BY first) AS aliases FROM (SELECT eid, p_brand, min((o, i)) AS first FROM items GROUP BY ALL) GROUP BY eid)
SELECT eid AS id, name, type, aliases, mentions, first_order FROM entities JOIN al USING (eid)
"""
SQL["person_merge"] = f"""
WITH {_EXT} SELECT pid AS id, arg_min(c_name, o) AS name, arg_min(c_mktsegment, o) AS role, count(*) AS mentions FROM items WHERE i = 1 GROUP BY pid
"""
SQL["frustration_merge"] = f"""
WITH {_EXT}, f AS (SELECT o, replace(text, ' prefers ', ' lacks ') AS text FROM texts WHERE kind = 'preference')
SELECT {_cid("'frustration'", 'left(text, 60)')} AS id, arg_max(text, o) AS text, min(o) AS first_order FROM f GROUP BY 1
"""
SQL["text_merge"] = f"WITH {_EXT} SELECT id, kind, text, first_order FROM merged_texts"
SQL["relationship_edges"] = f"WITH {_EXT} SELECT DISTINCT pid AS source, eid AS target, 'BOUGHT' AS type FROM every_item WHERE i <= 10 AND eid IN (SELECT eid FROM entities)"
SQL["chunk_nodes"] = f"""
WITH {_EXT} SELECT DISTINCT 'orders/' || o AS source, id FROM (SELECT o, eid AS id FROM items UNION ALL SELECT o, pid FROM items UNION ALL SELECT o, id FROM texts)
"""
SQL["co_occurrence_edges"] = f"""
WITH {_EXT},
names AS (SELECT DISTINCT eid AS id, lower(n) AS name FROM (SELECT eid, name AS n FROM entities UNION ALL SELECT eid, p_brand FROM items) UNION SELECT DISTINCT pid, lower(c_name) FROM items),
who AS (SELECT DISTINCT o, eid AS id FROM items UNION SELECT DISTINCT o, pid FROM items),
about AS (
  SELECT DISTINCT t.o, t.id AS source, w.id AS target FROM (SELECT DISTINCT o, id FROM texts) t JOIN merged_texts m USING (id) JOIN who w USING (o) JOIN names n ON n.id = w.id AND contains(lower(m.text), n.name)
),
rows AS (SELECT source, target, 'ABOUT' AS type FROM about UNION ALL SELECT id, 'document:' || left(sha256('orders/' || o), 12), 'FROM_SOURCE' FROM who)
SELECT source, target, type, count(*) AS weight FROM rows GROUP BY ALL
"""
_values = lambda rows: ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)
SQL["remap_entities"] = f"""
WITH e AS (SELECT {_cid("'entity'", 'n_name')} AS id, n_name AS name, 'nation ' || n_nationkey AS alias FROM nation),
m(ord, canonical, alias) AS (VALUES {_values(MERGES)}),
moves AS (SELECT id, arg_max(t, ord) AS t, min(ord) AS first FROM (SELECT ord, {_cid("'entity'", 'alias')} AS id, {_cid("'entity'", 'canonical')} AS t FROM m) WHERE id <> t GROUP BY id)
SELECT e.id, e.name, CAST(1 + count(o.id) AS BIGINT) AS mentions, e.alias || coalesce(string_agg(',' || o.alias || ',' || o.name, '' ORDER BY v.first) FILTER (o.id IS NOT NULL), '') AS aliases
FROM e LEFT JOIN moves v ON v.t = e.id LEFT JOIN e o ON o.id = v.id WHERE e.id NOT IN (SELECT id FROM moves) GROUP BY e.id, e.name, e.alias
"""
SQL["part_of_edges"] = f"""
WITH e AS (SELECT {_cid("'entity'", 'n_name')} AS id, n_name, n_nationkey FROM nation),
names AS (SELECT lower(n_name) AS name, id FROM e UNION ALL SELECT 'nation ' || n_nationkey, id FROM e),
p(ord, child, parent) AS (VALUES {_values(PARTS)})
SELECT coalesce(c.id, {_cid("'entity'", 'child')}) AS source, coalesce(q.id, {_cid("'entity'", 'parent')}) AS target, 'PART_OF' AS type
FROM p LEFT JOIN names c ON c.name = lower(child) LEFT JOIN names q ON q.name = lower(parent)
WHERE coalesce(c.id, {_cid("'entity'", 'child')}) IN (SELECT id FROM e) AND coalesce(q.id, {_cid("'entity'", 'parent')}) IN (SELECT id FROM e)
"""
_NOISY = ", ".join(f"'{n}'" for n in NOISE_ENTITIES)
_noise_name = lambda n: f"({n} IS NULL OR {n} = '' OR lower({n}) IN ({_NOISY}) OR length(lower({n})) < 3 OR regexp_full_match(lower({n}), '[0-9]+'))"
SQL["noise_entities"] = f"""
SELECT name, {_noise_name('name')} AS noise FROM (SELECT p_name AS name FROM part UNION SELECT event_type FROM events UNION SELECT CAST(o_orderkey AS VARCHAR) FROM orders)
"""
#: Beginnings of noise texts, with the word boundary as SQL engines write it.
_BEGINNINGS = (
    r"(go to|let''?s |ok\b|thanks|sure|will do|sounds good|i''?ll |yes\b|no\b)", r"(join|check |look |try |see |run |open |send |start |stop |i''?m going)", r"(sorry|please |hey |hi |good morning|good night|gm\b|gn\b)",
    r"(schedule |add .+ to (the )?calendar|remove .+ from (the )?calendar)", r"(going to|headed to)", r"\w+ (\w+ )?(is|was) (testing|fixing|finishing|working|doing|checking|looking|pushing|deploying)",
    r"need to (set up|configure|fix|check|look|update|deploy|push|test)\b",
)
_noise_text = lambda t: f"({t} IS NULL OR length({t}) < 25 OR length({t}) > 200 OR " + " OR ".join(f"regexp_matches({_TRIM.format(t)}, '(?i)^{b}')" for b in _BEGINNINGS) + ")"
SQL["noise_text"] = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INT) AS line FROM documents)
SELECT doc_id, line, {_noise_text('t')} AS noise FROM l
"""
SQL["near_duplicate_texts"] = """
SELECT arg_min('fact:' || doc_id, doc_id) AS id FROM documents GROUP BY left(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), 50)
"""

_NODES = """
nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'entity' AS type, r_name AS name, 'place' AS etype, NULL AS role, NULL AS text, NULL AS alias, (0, r_regionkey::BIGINT) AS ord FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'entity', n_name, 'place', NULL, NULL, NULL, (1, n_nationkey::BIGINT) FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'entity', s_name, 'organization', NULL, NULL, NULL, (2, s_suppkey) FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'entity', p_name, 'concept', NULL, NULL, p_brand, (3, p_partkey) FROM part
  UNION ALL SELECT 'customer:' || c_custkey, 'person', c_name, NULL, c_mktsegment, NULL, NULL, (4, c_custkey) FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'fact', NULL, NULL, NULL, 'Order ' || o_orderkey || ' of ' || c_name || ' has priority ' || o_orderpriority, NULL, (5, o_orderkey) FROM orders JOIN customer ON c_custkey = o_custkey
)"""
_GRAPH = f"""{_NODES},
edges AS (
  SELECT source, target, type, CASE WHEN count(*) > 1 THEN count(*) END AS weight FROM (
    SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'PART_OF' AS type FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'LOCATED_IN' FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN' FROM supplier
    UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'SUPPLIES' FROM lineitem
    UNION ALL SELECT 'customer:' || o_custkey, 'part:' || l_partkey, 'BOUGHT' FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'ABOUT' FROM orders
  ) GROUP BY ALL
)"""
_CORE = f"""{_GRAPH},
degree AS (SELECT id, count(*) AS d FROM (SELECT source AS id FROM edges WHERE type NOT IN ('ABOUT', 'FROM_SOURCE') UNION ALL SELECT target FROM edges WHERE type NOT IN ('ABOUT', 'FROM_SOURCE')) GROUP BY id),
core AS (
  SELECT n.id FROM nodes n LEFT JOIN degree USING (id)
  WHERE (type = 'entity' AND NOT {_noise_name('name')} AND coalesce(d, 0) >= 3) OR (type = 'person' AND coalesce(d, 0) >= 2)
)"""
SQL["core_survivors"] = f"WITH {_CORE} SELECT id FROM core"
_KEPT = f"""{_CORE},
touching AS (SELECT source AS id FROM edges WHERE type = 'ABOUT' AND target IN (SELECT id FROM core) UNION SELECT target FROM edges WHERE type = 'ABOUT' AND source IN (SELECT id FROM core)),
facts AS (
  SELECT arg_min(id, ord) AS id FROM nodes WHERE type = 'fact' AND NOT {_noise_text('text')} AND id IN (SELECT id FROM touching)
  GROUP BY left(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), 50)
),
kept AS (SELECT id FROM core UNION ALL SELECT id FROM facts)"""
SQL["filtered_nodes"] = f"WITH {_KEPT} SELECT id, type FROM nodes WHERE id IN (SELECT id FROM kept)"
SQL["filter_counts"] = f"WITH {_KEPT} SELECT count(*) FILTER (id IN (SELECT id FROM kept)) AS kept, count(*) FILTER (id NOT IN (SELECT id FROM kept)) AS cut FROM nodes"
SQL["filtered_edges"] = f"WITH {_KEPT} SELECT source, target, type, coalesce(weight, 1) AS weight FROM edges WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)"


def _pagerank(steps: int = 20) -> str:
    ctes = [_GRAPH, "v AS MATERIALIZED (SELECT id, (SELECT count(*) FROM nodes WHERE type <> 'fact') AS n FROM nodes WHERE type <> 'fact')"]
    ctes.append("o AS (SELECT source, sum(coalesce(weight, 1)) AS total FROM edges WHERE type <> 'ABOUT' GROUP BY source)")
    ctes.append("l AS MATERIALIZED (SELECT source, target, sum(0.85 * coalesce(weight, 1) / total::DOUBLE) AS share FROM edges JOIN o USING (source) WHERE type <> 'ABOUT' GROUP BY ALL)")
    ctes.append("s0 AS (SELECT id, 1.0::DOUBLE / n AS score FROM v)")
    for i in range(1, steps + 1):
        ctes.append(f"s{i} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE / n + coalesce(c, 0) AS score FROM v LEFT JOIN (SELECT target AS id, sum(share * score) AS c FROM l JOIN s{i - 1} ON source = id GROUP BY target) USING (id))")
    return f"WITH {', '.join(ctes)} SELECT id, round(score / (SELECT max(score) FROM s{steps}), 4) AS rank FROM s{steps}"


SQL["pagerank"] = _pagerank()


def _stem(w: str) -> str:
    """The stemmer as SQL, for the words of one query and of nodes."""
    rules = [("ies", 5, 3, "y"), ("sses", 4, 2, ""), ("ness", 4, 4, ""), ("ments", 5, 5, ""), ("ment", 5, 4, ""), ("ings", 6, 4, ""), ("ing", 6, 3, ""), ("tion", 6, 4, ""), ("ated", 4, 4, ""), ("ised", 4, 4, ""), ("ized", 4, 4, ""), ("ful", 4, 3, ""), ("ous", 4, 3, ""), ("ive", 4, 3, ""), ("able", 4, 4, ""), ("ible", 4, 4, ""), ("ally", 4, 4, ""), ("ily", 4, 3, ""), ("ly", 5, 2, ""), ("ed", 5, 2, ""), ("er", 5, 2, ""), ("es", 5, 2, "")]
    cases = " ".join(f"WHEN ends_with({w}, '{s}') AND length({w}) >= {n} THEN left({w}, length({w}) - {c}) || '{a}'" for s, n, c, a in rules)
    return f"CASE WHEN length({w}) < 4 OR {w} = 'ment' THEN {w} {cases} WHEN ends_with({w}, 's') AND NOT ends_with({w}, 'ss') THEN left({w}, length({w}) - 1) ELSE {w} END"


_STOPPED = ", ".join(f"'{w}'" for w in STOP_WORDS)
_FOUND = f"""{_NODES},
raw AS (SELECT DISTINCT term, min(pos) AS pos FROM (SELECT unnest(string_split('{SEARCH}', ' ')) AS term, generate_subscripts(string_split('{SEARCH}', ' '), 1) AS pos) WHERE length(term) > 2 AND term NOT IN ({_STOPPED}) GROUP BY term),
terms AS (SELECT term, min(p) AS p, {_stem('term')} AS root FROM (SELECT term, 2 * pos AS p FROM raw UNION ALL SELECT {_stem('term')}, 2 * pos + 1 FROM raw) GROUP BY term),
stems AS (SELECT count(DISTINCT {_stem('term')}) AS n FROM raw),
base AS (SELECT id, lower(concat_ws(' ', id, text, name, alias)) AS t FROM nodes),
texts AS (SELECT id, t || ' ' || array_to_string(list_transform(string_split(t, ' '), lambda w: {_stem('w')}), ' ') AS t FROM base),
hits AS (SELECT id, term, root, p FROM texts JOIN terms ON contains(t, term)),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
firsts AS (SELECT id, root, arg_min(term, p) AS term FROM hits GROUP BY id, root),
scored AS (SELECT id, sum(ln((SELECT count(*) FROM nodes) / df::DOUBLE) + 1) * (count(*) / (SELECT n FROM stems)::DOUBLE) AS score FROM firsts JOIN df USING (term) GROUP BY id)"""
SQL["search_scores"] = f"WITH {_FOUND} SELECT id, round(score, 6) AS score FROM scored"
SQL["search_top"] = f"""
WITH {_FOUND} SELECT id, round(score, 2) AS score, type, coalesce(name, text, id) AS label, alias AS aka FROM (SELECT * FROM scored JOIN nodes USING (id) ORDER BY round(score, 9) DESC, ord LIMIT 10)
"""
SQL["bfs_hops"] = f"""
WITH RECURSIVE {_GRAPH}, ways AS (SELECT source AS a, target AS b FROM edges WHERE type <> 'ABOUT' UNION SELECT target, source FROM edges WHERE type <> 'ABOUT'),
reach AS (SELECT 'region:1' AS id, 0 AS depth UNION SELECT b, depth + 1 FROM reach JOIN ways ON a = id WHERE depth < 2)
SELECT id, min(depth) AS depth FROM reach GROUP BY id
"""
SQL["neighbors"] = f"WITH {_GRAPH} SELECT target AS id FROM edges WHERE source = 'nation:7' UNION SELECT source FROM edges WHERE target = 'nation:7'"
SQL["incident_edges"] = f"WITH {_GRAPH} SELECT 'out' AS direction, source, target, type FROM edges WHERE source = 'supplier:3' UNION ALL SELECT 'in', source, target, type FROM edges WHERE target = 'supplier:3'"
SQL["degrees"] = f"""
WITH {_GRAPH} SELECT id, count(*) AS degree, round(3.0::DOUBLE + least(6.0, sqrt(count(*)) * 1.5), 6) AS radius FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id
"""
SQL["graph_counts"] = f"WITH {_GRAPH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges"
SQL["graph_stats"] = f"WITH {_GRAPH} SELECT 'node' AS what, type, count(*) AS count FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type"
SQL["type_subgraph"] = f"WITH {_GRAPH}, e AS (SELECT id FROM nodes WHERE type = 'entity') SELECT source, target, type, coalesce(weight, 1) AS weight FROM edges WHERE source IN (SELECT id FROM e) AND target IN (SELECT id FROM e)"
SQL["node_detail"] = f"""
WITH {_GRAPH}, i AS (SELECT 'out' AS direction, type AS edge_type, target AS other FROM edges WHERE source = 'supplier:3' UNION ALL SELECT 'in', type, source FROM edges WHERE target = 'supplier:3')
SELECT direction, edge_type, other, type AS other_type, coalesce(name, text, id) AS label FROM i LEFT JOIN nodes ON id = other
"""
SQL["merged_nodes"] = f"""
WITH {_GRAPH}
SELECT id, type, name, CASE WHEN type = 'person' THEN lower(role) END AS role FROM nodes WHERE type <> 'fact'
UNION ALL SELECT id, NULL, NULL, NULL FROM nodes WHERE type = 'fact'
"""
SQL["merged_edges"] = f"WITH {_GRAPH} SELECT source, target, type, CASE WHEN type = 'ABOUT' THEN coalesce(weight, 1) ELSE 7 END AS weight FROM edges WHERE type <> 'BOUGHT'"
SQL["dot_export"] = f"""
WITH {_GRAPH}, p AS (SELECT * FROM nodes WHERE etype = 'place')
SELECT part, line FROM (VALUES (0, 'digraph G {{'), (0, '  rankdir=LR;'), (0, '  node [shape=box, fontsize=10];'), (3, '}}')) t(part, line)
UNION ALL SELECT 1, '  "' || id || '" [label="' || name || '", style=filled, fillcolor="lightblue"];' FROM p
UNION ALL SELECT 2, '  "' || source || '" -> "' || target || '" [label="' || type || '", fontsize=8];' FROM edges WHERE source IN (SELECT id FROM p) AND target IN (SELECT id FROM p)
"""
