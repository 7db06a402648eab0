"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from . import chat, secrets, warc

SQL: dict[str, str] = {}

_CONTROL = f"(<({chat._ANGLE})|\\[({chat._SQUARE}))"
_OVER = len(chat.OPEN) + len(chat.MID) + len(chat.CLOSE)


def _escaped_length(x: str) -> str:
    """Code points of the escaped form: one more for each backslash and control string."""
    return f"(length({x}) + length({x}) - length(replace({x}, '\\', '')) + len(regexp_extract_all({x}, '{_CONTROL}')))"


SQL["op3_chat_formatting"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  sum({_OVER} + {_escaped_length('role')} + {_escaped_length('text')})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL["op9_benchmark_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT item, least(len(w), 10) AS n,
    unnest(CASE WHEN len(w) < 10 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i+9], ' ')) END) AS win
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
pos AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT DISTINCT a.r, a.i, a.n, x.item FROM pos a JOIN bw x ON x.n = a.n AND x.win = array_to_string(a.w[a.i:a.i+a.n-1], ' ')),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

_TOKENS = f"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+')"

SQL["op10_minhash_near_dedup"] = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_TOKENS} AS w FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) END) AS g FROM d),
u AS (SELECT DISTINCT doc_id, len(g) AS n, unnest(g) AS x FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared
  FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common WHERE 100 * shared >= 85 * (na + nb - shared)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(n, m) AS (SELECT a, a FROM edge UNION SELECT e.b, reach.m FROM reach JOIN edge e ON e.a = reach.n),
least_of AS (SELECT n, min(m) AS component_id FROM reach GROUP BY n)
SELECT doc_id, len(g)::BIGINT AS n_shingles, least(doc_id, coalesce(component_id, doc_id)) AS component_id,
  coalesce(component_id, doc_id) = doc_id AS kept
FROM s LEFT JOIN least_of ON n = doc_id
"""

SQL["op2_embedding_near_dedup"] = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(n, m) AS (SELECT a, a FROM edge UNION SELECT e.b, reach.m FROM reach JOIN edge e ON e.a = reach.n),
least_of AS (SELECT n, min(m) AS component_id FROM reach GROUP BY n),
degree AS (SELECT a, count(*) AS n_links FROM edge GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least_of ON n = vec_id LEFT JOIN degree ON a = vec_id
"""

_BARE = "regexp_replace(regexp_replace(trim(coalesce(url, '')), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*:(//)', '\\1')"
_HOST = f"regexp_replace(regexp_replace(lower(regexp_extract({_BARE}, '^//(?:[^/?@]*@)?([^/?]*)', 1)), ':(?:80|443)$', ''), '^www[0-9]*\\.', '')"
_PATH = f"regexp_extract({_BARE}, '^//[^/?]*([^?]*)', 1)"
_QUERY = f"array_to_string(list_sort(list_filter(string_split(regexp_extract({_BARE}, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(?:{'|'.join(warc.TRACKING)})(?:=|$)'))), '&')"

SQL["op6_warc_revisits"] = f"""
WITH u AS (SELECT page_id, sha256(coalesce(html, '')) AS sha, length(coalesce(html, '')) AS n, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query FROM pages),
k AS (SELECT *, CASE WHEN host = '' THEN '' ELSE host || CASE WHEN path = '' THEN '/' ELSE regexp_replace(regexp_replace(path, '/index\\.(?:html?|php)$', '/'), '(.)/$', '\\1') END || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS url_key,
  '"' || sha[1:16] || '"' AS tag, 'day ' || (page_id // 7) AS day FROM u),
v AS (SELECT page_id, url_key, tag, day, page_id * 4 + 401 AS ts FROM k),
hit AS (SELECT v.page_id, max_by(k.page_id, k.page_id) AS p FROM v JOIN k ON k.url_key = v.url_key AND k.page_id * 4 <= v.ts GROUP BY v.page_id),
j AS (SELECT v.*, r.page_id AS rp, r.sha AS rsha, r.tag AS rtag, r.day AS rday, r.n AS rn,
  CASE WHEN v.page_id % 3 <> 0 THEN v.tag END AS etag, CASE WHEN v.page_id % 9 = 0 THEN v.day END AS modified
  FROM v LEFT JOIN hit USING (page_id) LEFT JOIN k r ON r.page_id = hit.p),
s AS (SELECT *, CASE WHEN url_key = '' OR rp IS NULL THEN 'unresolved' WHEN etag <> rtag OR (modified <> rday AND coalesce(etag <> rtag, true)) THEN 'mismatch'
  WHEN etag = rtag OR modified = rday THEN 'resolved' ELSE 'unvalidated' END AS status FROM j)
SELECT page_id * 2 AS record_id, url_key, page_id * 4 AS ts, 'response' AS kind, 'full' AS status, NULL::BIGINT AS response_id, sha AS digest,
  'content-length=' || n || chr(10) || 'content-type=text/html' || chr(10) || 'date=' || page_id * 4 || chr(10) || 'etag=' || tag || chr(10) || 'last-modified=' || day AS headers FROM k
UNION ALL
SELECT page_id * 2 + 1, url_key, ts, 'revisit', status, CASE WHEN status <> 'unresolved' THEN rp * 2 END, CASE WHEN status = 'resolved' THEN rsha END,
  'cache-control=max-age=60' || chr(10) || CASE WHEN status = 'resolved' THEN
    'content-length=' || rn || chr(10) || 'content-type=text/html' || chr(10) || 'date=' || ts || chr(10) || 'etag=' || coalesce('W/' || etag, rtag) || chr(10) || 'last-modified=' || coalesce(modified, rday)
  ELSE 'content-length=0' || chr(10) || 'date=' || ts || coalesce(chr(10) || 'etag=W/' || etag, '') || coalesce(chr(10) || 'last-modified=' || modified, '') END FROM s
"""


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _secret_parts(kind: int, head: str, value: str, least: int) -> str:
    """Matches of one kind, in order: the text before each, its head and its value."""
    groups = ", ".join(f"unnest(regexp_extract_all(t, {_sql_text(f'(?s:(.*?))({head})({value})')}, {g})) AS {name}" for g, name in ((1, "g"), (2, "h"), (3, "v")))
    return f"SELECT r, {kind} AS kind, {least} AS least, unnest(range(len(regexp_extract_all(t, {_sql_text(f'(?s:(.*?))({head})({value})')}, 3)))) AS i, {groups} FROM d"


_KIND = "['assign', 'access', 'hex', 'live'][kind + 1]"

SQL["op4_secret_scans"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source AS owner, concat_ws('/', source, lang) AS repo FROM documents),
m AS ({_secret_parts(0, f"(?i:{secrets.ASSIGN})", secrets.ASSIGN_VALUE, 12)} UNION ALL {_secret_parts(1, "", secrets.ACCESS, 18)} UNION ALL {_secret_parts(2, "", secrets.HEX, 16)}),
e AS (SELECT *, sum(length(g) + length(h) + length(v)) OVER (PARTITION BY r, kind ORDER BY i) AS stop FROM m),
base AS (SELECT r, kind, stop - length(h) - length(v) AS start, stop - length(v) AS low, stop, v,
  len(list_distinct(string_split(v, ''))) >= {secrets.LIVE_DISTINCT} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AS random FROM e WHERE length(v) >= least),
places AS (SELECT DISTINCT v, owner, repo FROM base JOIN d USING (r)),
owners AS (SELECT v, count(*) AS owners, sum(n) AS repos FROM (SELECT v, owner, count(*) AS n FROM places GROUP BY v, owner) GROUP BY v),
told AS (SELECT r, low, stop, random AND owners = 1 AND repos <= {secrets.LIVE_REPOS} AS live, owners >= {secrets.EXAMPLE_OWNERS} OR repos >= {secrets.EXAMPLE_REPOS} AS copied FROM base JOIN owners USING (v)),
spans AS (SELECT r, kind, start, stop FROM base UNION ALL SELECT DISTINCT r, 3, low, stop FROM told WHERE live),
lists AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, count(*) FILTER (WHERE kind = 3) AS n_live,
  string_agg({_KIND} || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind, stop) AS spans,
  string_agg({_KIND} || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind, stop) FILTER (WHERE kind < 3) AS base_spans FROM spans GROUP BY r),
examples AS (SELECT r, count(*) AS n_copied FROM (SELECT DISTINCT r, low, stop FROM told WHERE copied) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied
FROM d LEFT JOIN lists USING (r) LEFT JOIN examples USING (r)
"""
