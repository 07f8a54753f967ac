"""DuckDB SQL for the queries that SQL can express."""

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""

URL_FILTERS = r"""
WITH r(rule, host, path, verdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p),
f AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY page_id)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM u LEFT JOIN f USING (page_id)
"""

_KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
)


def _matches(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    """``doc_id, s, k, e, kind``: matches in order, their ends a running sum over the pieces between and the matches."""
    return f"""
SELECT doc_id, e - n AS s, {place} AS k, e, '{kind}' AS kind FROM (
  SELECT doc_id, n, v, sum(g + n) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
    SELECT doc_id, unnest(range(len(m))) AS i, length(unnest(gaps[:len(m)])) AS g,
           length(unnest(m)) AS n, length(unnest(v)) AS v
    FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS m,
                 regexp_extract_all(text, '{pattern}', {group}) AS v
          FROM documents WHERE regexp_matches(text, '{pattern}'))))
WHERE v >= {least}"""


SECRET_SCAN = f"""
WITH spans AS ({' UNION ALL '.join(_matches(i, *k) for i, k in enumerate(_KINDS))}),
joined AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
         count(*) FILTER (k = 2) AS n_hex,
         string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN joined USING (doc_id)
"""

FORMAT_CHATS = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (
  SELECT *, replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), ': ', ':\ '), '</turn>', '<\/turn>') AS r,
         replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>') AS t
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(r) + 2 + length(t) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def _lloyd(assigned: str, book: str, new: str) -> str:
    """One round: the parts of ``{assigned}_in`` assigned to ``book``, and the entries moved."""
    return f"""
{assigned} AS (
  SELECT vec_id, label, p, any_value(x) AS x, min((d, e))[2] AS e, min((d, e))[1] AS d FROM (
    SELECT v.vec_id, v.label, v.p, v.x, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts v JOIN {book} b ON v.p = b.p) GROUP BY vec_id, label, p)""" + (f""",
{new} AS (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (
    SELECT p, e, list(m ORDER BY i) AS x FROM (
      SELECT p, e, i, (sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS m
      FROM (SELECT p, e, unnest(x) AS c, unnest(range(len(x))) AS i FROM {assigned}) GROUP BY p, e, i)
    GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)""" if new else "")


VECTOR_CODES = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT vec_id, label, p, x[p * (len(x) // 16) + 1:(p + 1) * (len(x) // 16)] AS x
  FROM kept, (SELECT unnest(range(16)) AS p)),
b0 AS (
  SELECT p, e, x FROM parts JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),
{_lloyd("a0", "b0", "b1")},
{_lloyd("a1", "b1", "b2")},
{_lloyd("a2", "b2", "")},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM coded
"""
