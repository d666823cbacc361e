"""SQL for the queries that SQL can express, over whole tables."""

OP1 = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS window_text
  FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i)
  WHERE len(w) > 0
), doc_words AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), sizes AS (SELECT DISTINCT n FROM windows),
doc_windows AS (
  SELECT row_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS window_text
  FROM doc_words, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)
), found AS (
  SELECT d.row_id, d.i, d.n, x.item_id FROM doc_windows d JOIN windows x USING (n, window_text)
), hit AS (
  SELECT row_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT row_id, i, n FROM found), unnest(range(0, n)) AS t(j) GROUP BY row_id
), items AS (
  SELECT row_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS name FROM found WHERE item_id IS NOT NULL) GROUP BY row_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (row_id) LEFT JOIN items USING (row_id)
"""

OP2 = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents),
lines AS (SELECT row_id, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM docs WHERE text IS NOT NULL),
normal AS (
  SELECT *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS x FROM lines
),
nodes AS (SELECT x, row_number() OVER (ORDER BY x) AS node FROM (SELECT DISTINCT x FROM normal WHERE x <> '')),
shingles AS (SELECT DISTINCT node, substr(x, i, 9) AS s FROM nodes, unnest(range(1, greatest(length(x) - 8, 1) + 1)) AS t(i)),
sized AS (SELECT node, s, count(*) OVER (PARTITION BY node) AS n, count(*) OVER (PARTITION BY s) AS f FROM shingles),
prefix AS (SELECT node, s, n FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY f, s) AS r FROM sized) WHERE r <= n - ceil(0.8 * n) + 1 AND f > 1),
pairs AS (SELECT DISTINCT a.node AS a, b.node AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b ON a.s = b.s AND a.node < b.node AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
links AS (
  SELECT a, b FROM pairs JOIN shingles x ON x.node = a JOIN shingles y ON y.node = b AND x.s = y.s
  GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))
),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS seen FROM edges UNION SELECT node, b FROM reach JOIN edges ON seen = a),
roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node),
placed AS (SELECT row_id, doc_id, line, place, node, coalesce(root, node) AS root FROM normal LEFT JOIN nodes USING (x) LEFT JOIN roots USING (node)),
judged AS (
  SELECT row_id, line, place, node IS NULL OR (doc_id IS NOT NULL, coalesce(doc_id, 0), place) = min((doc_id IS NOT NULL, coalesce(doc_id, 0), place)) OVER (PARTITION BY root) AS stays FROM placed
),
kept AS (SELECT row_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed, string_agg(line, chr(10) ORDER BY place) FILTER (stays) AS text FROM judged GROUP BY row_id)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept k USING (row_id)
"""

OP5 = r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT row_id, doc_id, i, array_to_string(w[i : i + 49], ' ') AS window_text FROM doc_words, unnest(range(1, len(w) - 48)) AS t(i)
), later AS (
  SELECT row_id, i FROM (SELECT row_id, i, doc_id, min(doc_id) OVER (PARTITION BY window_text) AS least FROM windows) WHERE doc_id > least
), removed AS (
  SELECT DISTINCT row_id, i + j AS pos FROM later, unnest(range(0, 50)) AS t(j)
), kept AS (
  SELECT row_id, string_agg(word, ' ' ORDER BY pos) AS words, count(*) AS n
  FROM (SELECT row_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM doc_words) ANTI JOIN removed USING (row_id, pos) GROUP BY row_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM doc_words LEFT JOIN kept USING (row_id)
"""

OP9 = r"""
WITH RECURSIVE doc_words AS (
  SELECT row_number() OVER () AS row_id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT row_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 2], ' ') END AS s
  FROM doc_words, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT row_id, count(*) AS n FROM shingles GROUP BY row_id),
classes AS (SELECT row_id, min(row_id) OVER (PARTITION BY d) AS class FROM (SELECT row_id, string_agg(s, chr(10) ORDER BY s) AS d FROM shingles GROUP BY row_id)),
firsts AS (SELECT row_id, s, n FROM shingles JOIN sizes USING (row_id) WHERE row_id IN (SELECT class FROM classes)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY f, s) AS r FROM firsts JOIN (SELECT s, count(*) AS f FROM firsts GROUP BY s) USING (s)),
prefix AS (SELECT row_id, s, n FROM ranked WHERE r <= n - ceil(0.9 * n) + 1),
pairs AS (
  SELECT DISTINCT a.row_id AS x, b.row_id AS y, a.n AS nx, b.n AS ny
  FROM prefix a JOIN prefix b ON a.s = b.s AND a.row_id < b.row_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
), links AS (
  SELECT x, y FROM pairs JOIN firsts a ON a.row_id = x JOIN firsts b ON b.row_id = y AND a.s = b.s
  GROUP BY x, y, nx, ny HAVING 100 * count(*) >= 90 * (nx + ny - count(*))
), edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT DISTINCT class AS node, class AS seen FROM classes
  UNION
  SELECT node, y FROM reach JOIN edges ON seen = x
), roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node),
components AS (
  SELECT d.row_id, doc_id, min(doc_id) OVER (PARTITION BY root) AS component_id
  FROM doc_words d JOIN classes USING (row_id) JOIN roots ON class = node
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM doc_words d LEFT JOIN sizes USING (row_id) LEFT JOIN components USING (row_id)
"""

_TAIL = r"(?:(?:ac|co|com|edu|gov|net|or|org)\.[a-z][a-z]|[^.]*)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HOST = _LOWER.format(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")
_PATH = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _strength(rows: str) -> str:
    m = "least(greatest(m, 1e-6), 1 - 1e-6)"
    q, n, pairs = f"sum(pow(k - n * {m}, 2) / ({m} * (1 - {m})))", "sum(n)", "sum(n * (n - 1))"
    r = f"(({q} - {n}) / nullif({pairs}, 0))"
    return f"(SELECT coalesce(CASE WHEN {r} > 0 THEN least(greatest(1 / {r} - 1, 2.0), 1000.0) END, 1000.0) FROM {rows})"


def _shrink(rows: str, keys: str) -> str:
    weight = _strength(rows)
    return f"SELECT {keys}, m * {weight} + k AS a, (1 - m) * {weight} + n - k AS b FROM {rows}"


OP10 = rf"""
WITH seen AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
outcomes AS (
  SELECT host, quality AS good
  FROM (SELECT host, regexp_extract(path, '/([0-9]{{1,18}})(?:\.html)?/?$', 1) AS d FROM seen) s
  JOIN (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) l ON s.d <> '' AND TRY_CAST(s.d AS BIGINT) = l.doc_id
),
hosts AS (
  SELECT host, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS k,
    coalesce(nullif(regexp_extract(host, '(?:^|\.)([^.]+\.{_TAIL})$', 1), ''), regexp_extract(host, '(?:^|\.)({_TAIL})$', 1)) AS domain,
    regexp_extract(host, '(?:^|\.)({_TAIL})$', 1) AS suffix
  FROM outcomes GROUP BY host
),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
total AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(k) + 1) / (sum(n) + 2) END AS m FROM suffixes),
s_rows AS (SELECT suffix, n, k, (SELECT m FROM total) AS m FROM suffixes),
by_suffix AS ({_shrink("s_rows", "suffix")}),
d_rows AS (SELECT domain, n, k, a / (a + b) AS m FROM domains JOIN by_suffix USING (suffix)),
by_domain AS ({_shrink("d_rows", "domain")}),
h_rows AS (SELECT host, n, k, a / (a + b) AS m FROM hosts JOIN by_domain USING (domain)),
by_host AS ({_shrink("h_rows", "host")}),
rules(verdict, rule_host, rule_path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
ruled AS (
  SELECT host, path, arg_max(verdict, length(rule_host || rule_path)) AS verdict, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule
  FROM (SELECT DISTINCT host, path FROM seen) p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
),
judged AS (
  SELECT host, coalesce(h.a, d.a, s.a, t.m * 1000.0) AS a, coalesce(h.b, d.b, s.b, (1 - t.m) * 1000.0) AS b
  FROM (
    SELECT DISTINCT host,
      coalesce(nullif(regexp_extract(host, '(?:^|\.)([^.]+\.{_TAIL})$', 1), ''), regexp_extract(host, '(?:^|\.)({_TAIL})$', 1)) AS domain,
      regexp_extract(host, '(?:^|\.)({_TAIL})$', 1) AS suffix
    FROM seen
  ) x LEFT JOIN by_host h USING (host) LEFT JOIN by_domain d USING (domain) LEFT JOIN by_suffix s USING (suffix), total t
), bounds AS (
  SELECT host, a, b, 1 / (2 * a - 1) AS p, 1 / (2 * b - 1) AS q, 2 / (1 / (2 * a - 1) + 1 / (2 * b - 1)) AS h, (1.645 * 1.645 - 3) / 6 AS lam FROM judged
), quantiles AS (
  SELECT host, CASE WHEN a > 0.5 AND b > 0.5 AND h + lam > 0
    THEN a / (a + b * exp(2 * (-1.645 * sqrt(greatest(h + lam, 0)) / h - (q - p) * (lam + 5.0::DOUBLE / 6 - 2 / (3 * h)))))
    ELSE pow(sin(least(greatest(asin(sqrt(a / (a + b))) + 1.645 / (2 * sqrt(a + b)), 0), 1.5707963267948966)), 2) END AS upper_bound
  FROM bounds
)
SELECT page_id, host, path, r.rule,
  coalesce(r.verdict, CASE WHEN upper_bound < (SELECT m FROM total) THEN 'block' ELSE 'allow' END) AS verdict
FROM seen LEFT JOIN ruled r USING (host, path) JOIN quantiles USING (host)
"""

#: The columns of op6_rules that do not come from the trained chain.
OP6_BASE = r"""
WITH doc AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM doc),
dups AS (SELECT row_id, sum(n - 1) AS n FROM (SELECT row_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY row_id),
windows AS (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, w[i], w[i + 1], w[i + 2]) AS n FROM doc, unnest(range(1, len(w) - 1)) AS t(i)),
repeated AS (SELECT row_id, count(DISTINCT i + j) AS n FROM windows, unnest(range(0, 3)) AS t(j) WHERE n > 1 GROUP BY row_id),
counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM doc LEFT JOIN dups d USING (row_id) LEFT JOIN repeated r USING (row_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
"""

SQL = {"op1_decontaminate": OP1, "op2_lines": OP2, "op5_substring": OP5, "op9_jaccard": OP9, "op10_urls": OP10}
