"""DuckDB SQL for those queries of this subpackage that SQL can express."""

ORACLES: dict[str, str] = {}

#: One row per document with its distinct 5-word shingles, then links of at least 75 in 100, then what is reachable.
ORACLES["op8_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS sh FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.k >= 75 * (x.n + y.n - p.k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.b, w.doc_id)) AS component_id,
       least(w.doc_id, coalesce(c.b, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id
"""

#: Windows as strings of words, joined to every stretch of as many document words; hit words are distinct positions.
ORACLES["op6_suffix_automaton_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
v AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS m, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i + 9], ' '))) AS win FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT m FROM v),
dw AS (
  SELECT doc_id, m, unnest(range(1, len(ws) - m + 2)) AS i, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS win
  FROM d, sizes WHERE len(ws) >= m),
h AS (SELECT dw.doc_id, dw.i, dw.m, v.item_id FROM dw JOIN v ON v.win = dw.win AND v.m = dw.m),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(hit.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.items, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""

#: Base 32 from hexadecimal: 20 bits, so five digits, make four letters.
ORACLES["op7_arc_to_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, upper(sha1(coalesce(html, ''))) AS h FROM pages),
m AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
x AS (
  SELECT page_id, html, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT)) AS q FROM p)
SELECT x.page_id, CAST(octet_length(encode(x.html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(q, lambda v:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31) + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN m.first = x.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m.first = x.page_id THEN NULL ELSE m.first END AS refers_to
FROM x JOIN m ON m.html = x.html
"""

#: Twenty rounds of both ranks over links and domain steps, from hosts that rules allow or block.
ORACLES["op9_link_graph_url_filter"] = r"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(html, '') AS html,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
m AS (
  SELECT *, '.' || host AS h, CASE
    WHEN '.' || host LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN '.' || host LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN '.' || host LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN '.' || host LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
    WHEN '.' || host LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule FROM p),
s AS (
  SELECT host, coalesce(bool_or(rule IN ('org/', 'com/fr/')), false) AS trusted, coalesce(bool_or(rule NOT IN ('org/', 'com/fr/')), false) AS blocked
  FROM m WHERE host <> '' GROUP BY host),
k0 AS (
  SELECT DISTINCT src, dst FROM (
    SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
    FROM p WHERE host <> '') WHERE src <> dst),
hosts AS (SELECT src AS host FROM k0 UNION SELECT dst FROM k0 UNION SELECT host FROM s),
steps AS (
  SELECT DISTINCT array_to_string(l[i:], '.') AS a, array_to_string(l[i + 1:], '.') AS b
  FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM (SELECT string_split(host, '.') AS l FROM hosts) WHERE len(l) > 2)),
k AS (SELECT src, dst FROM k0 UNION SELECT a, b FROM steps WHERE a <> '' AND b <> '' UNION SELECT b, a FROM steps WHERE a <> '' AND b <> ''),
e AS (SELECT 'trust' AS kind, src, dst FROM k UNION ALL SELECT 'distrust', dst, src FROM k),
w AS (SELECT *, 0.85::DOUBLE / count(*) OVER (PARTITION BY kind, src) AS share FROM e),
seed AS (
  SELECT kind, host, 1::DOUBLE / count(*) OVER (PARTITION BY kind) AS rank
  FROM (SELECT 'trust' AS kind, host FROM s WHERE trusted UNION ALL SELECT 'distrust', host FROM s WHERE blocked)),
nodes AS (SELECT kind, host FROM seed UNION SELECT kind, src FROM e UNION SELECT kind, dst FROM e),
r AS (
  SELECT 0 AS i, kind, host, rank FROM seed
  UNION ALL
  SELECT any_value(x.i), n.kind, n.host, 0.15::DOUBLE * coalesce(any_value(seed.rank), 0) + coalesce(sum(x.rank * w.share), 0)
  FROM nodes n LEFT JOIN seed ON seed.kind = n.kind AND seed.host = n.host
  JOIN (SELECT i + 1 AS i, kind, host, rank FROM r WHERE i < 20 UNION ALL SELECT (SELECT max(i) + 1 FROM r), NULL, NULL, 0 WHERE (SELECT max(i) FROM r) < 20) x
    ON true
  LEFT JOIN w ON w.kind = n.kind AND w.dst = n.host AND w.src = x.host AND w.kind = x.kind
  GROUP BY n.kind, n.host),
f AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN rank ELSE -rank END) AS net FROM r WHERE i = 20 GROUP BY host)
SELECT m.page_id, m.host, m.path, m.rule,
       CASE WHEN m.rule IN ('org/', 'com/fr/') THEN 'allow' WHEN m.rule IS NOT NULL THEN 'block'
            WHEN round(-coalesce(f.net, 0), 12) > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM m LEFT JOIN f ON f.host = m.host
"""

ORACLES["op10_tool_call_linking"] = r"""
WITH t AS (
  SELECT conv_id, turn, role, text, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         'call_' || CAST(CASE role WHEN 'user' THEN turn WHEN 'assistant' THEN turn - 1 END AS VARCHAR) AS call_id FROM conversations),
c AS (SELECT conv_id, call_id, min(CASE WHEN kind = 'call' THEN turn END) AS call_turn, bool_or(kind = 'result') AS answered
      FROM t WHERE kind <> 'message' GROUP BY 1, 2)
SELECT t.conv_id, t.turn, t.role, t.kind, t.call_id,
       CASE t.kind WHEN 'call' THEN coalesce(c.answered, false) WHEN 'result' THEN coalesce(c.call_turn IS NOT NULL, false) ELSE false END AS linked,
       CASE WHEN t.kind = 'call' THEN text IS NOT NULL AND t.turn IS NOT NULL END AS valid,
       CASE WHEN t.kind = 'result' THEN greatest(t.turn, c.call_turn) ELSE t.turn END AS order_turn,
       0 AS level, CASE WHEN t.kind = 'result' THEN 1 ELSE 0 END AS order_phase,
       '{' || array_to_string(list_filter([
         CASE WHEN t.kind = 'call' THEN '"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"chars":' || length(text) || ',"prompt":' || to_json(text)::VARCHAR || ',' END || '"turn":' || t.turn || '}' END,
         '"call_id":' || to_json(t.call_id)::VARCHAR,
         CASE WHEN t.kind <> 'call' AND text IS NOT NULL THEN '"content":' || to_json(text)::VARCHAR END,
         '"kind":' || to_json(t.kind)::VARCHAR,
         CASE WHEN t.role IS NOT NULL THEN '"role":' || to_json(t.role)::VARCHAR END,
         CASE WHEN t.kind = 'call' THEN '"tool":"reply"' END], lambda x: x IS NOT NULL), ',') || '}' AS message
FROM t LEFT JOIN c ON c.conv_id = t.conv_id AND c.call_id = t.call_id
"""


def _assigned(rows: str, books: str) -> str:
    """Of each part its nearest entry (ties: the lowest index), as distance * 64 + index."""
    away = " + ".join(f"(s.q[{j}] - b.q[{j}]) * (s.q[{j}] - b.q[{j}])" for j in range(1, 5))
    return f"SELECT s.vec_id, s.p, s.q, min(({away}) * 64 + b.i) AS k FROM {rows} s JOIN {books} b ON b.p = s.p GROUP BY ALL"


def _moved(found: str, books: str) -> str:
    means = ", ".join(f"CAST(floor(sum(q[{j}]) / count(*)) AS BIGINT)" for j in range(1, 5))
    return f"SELECT b.p, b.i, coalesce(m.q, b.q) AS q FROM {books} b LEFT JOIN (SELECT p, k % 64 AS i, [{means}] AS q FROM {found} GROUP BY ALL) m ON m.p = b.p AND m.i = b.i"


ORACLES["op11_annular_vector_codes"] = f"""
WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT vec_id, p, v[4 * p + 1:4 * p + 4] AS q FROM e, range(16) t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i, q FROM s WHERE vec_id IN (SELECT vec_id FROM e ORDER BY vec_id LIMIT 64)),
a0 AS MATERIALIZED ({_assigned("s", "b0")}),
b1 AS MATERIALIZED ({_moved("a0", "b0")}),
a1 AS MATERIALIZED ({_assigned("s", "b1")}),
b2 AS MATERIALIZED ({_moved("a1", "b1")}),
a2 AS MATERIALIZED ({_assigned("s", "b2")}),
c AS (SELECT vec_id, string_agg(format('{{:02x}}', CAST(k % 64 AS INT)), '' ORDER BY p) AS code, CAST(sum(k // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(CAST(q[j] AS VARCHAR), ',' ORDER BY p, i, j)) AS codebooks_sha256 FROM b2, range(1, 5) t(j))
SELECT e.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY e.label) AS BIGINT) AS label_error, h.codebooks_sha256 FROM e JOIN c ON c.vec_id = e.vec_id, h
"""


def _nearest(centroids: str) -> str:
    """Of each vector its nearest centroid (ties: the smaller number), as distance * 16 + number."""
    away = "list_sum(list_transform(list_zip(e.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
    return f"SELECT e.vec_id, e.v, min(CAST({away} AS BIGINT) * 16 + c.i) AS k FROM e JOIN {centroids} c ON true GROUP BY ALL"


def _means(found: str, centroids: str) -> str:
    sums = f"SELECT i, j, CAST(floor(sum(v[j]) / count(*)) AS BIGINT) AS x FROM (SELECT k % 16 AS i, v FROM {found}), range(1, 65) t(j) GROUP BY ALL"
    return f"SELECT c.i, coalesce(m.v, c.v) AS v FROM {centroids} c LEFT JOIN (SELECT i, list(x ORDER BY j) AS v FROM ({sums}) GROUP BY i) m ON m.i = c.i"


ORACLES["op13_gemm_centroid_clusters"] = f"""
WITH e AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS i, v FROM e QUALIFY i < 16),
a0 AS MATERIALIZED ({_nearest("c0")}),
c1 AS MATERIALIZED ({_means("a0", "c0")}),
a1 AS MATERIALIZED ({_nearest("c1")}),
c2 AS MATERIALIZED ({_means("a1", "c1")}),
a2 AS MATERIALIZED ({_nearest("c2")}),
c3 AS MATERIALIZED ({_means("a2", "c2")}),
a3 AS MATERIALIZED ({_nearest("c3")})
SELECT a.vec_id, CAST(a.k % 16 AS INT) AS cluster, a.k // 16 AS distance, CAST(sum(a.k // 16) OVER (PARTITION BY a.k % 16) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.k // 16) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a3 a JOIN c3 c ON c.i = a.k % 16
"""
