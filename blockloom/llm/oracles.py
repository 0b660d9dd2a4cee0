"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from .secrets import MORE

URL_FILTER = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r AS (
  SELECT *, '.' || host AS h, '.' || host || path AS u FROM p),
w AS (
  SELECT page_id, host, path,
    CASE WHEN ends_with(h, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN ends_with(h, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN ends_with(h, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN ends_with(h, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    CASE WHEN regexp_matches(u, '(?s)^[^/]*\.casino[^/]*/') THEN '*.casino*/**'
         WHEN regexp_matches(u, '(?s)/track[^/]/') THEN '**/track?/**'
         WHEN regexp_matches(u, '(?s)^[^/]*\.spam-[^/]*/') THEN '*.spam-*/**'
         WHEN contains(u, '/ads/') THEN '**/ads/**'
         WHEN ends_with(u, '.exe') THEN '**.exe' END AS own
  FROM r)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NULL THEN own WHEN rule LIKE '%/' AND rule <> '' THEN '*.' || rule || '**' END AS pattern,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR own IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM w
"""

#: Every pair of a label is compared; reachable vectors by recursion.
EMBEDDING_DEDUP = """
WITH RECURSIVE e AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
good AS MATERIALIZED (
  SELECT r, vec_id, label, x FROM e
  WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(x, lambda v: v <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (
  SELECT a, min(vec_id) AS other FROM reach JOIN e ON e.r = reach.b GROUP BY a),
degree AS (
  SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(other, vec_id)) AS component_id, vec_id <= coalesce(other, vec_id) AS kept
FROM e LEFT JOIN least ON least.a = e.r LEFT JOIN degree ON degree.a = e.r
"""

#: (kind, pattern, group, characters that it has at least): the base kinds as they are specified, then the published forms.
_KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    *((r.kind, r.pattern, r.group, r.least) for r in MORE),
)


def _secrets() -> str:
    """Matches are read with the gap before each, so lengths add up to places."""
    found = []
    for k, (kind, pattern, group, least) in enumerate(_KINDS):
        p = pattern.replace("'", "''")
        part = lambda g, p=p: f"unnest(regexp_extract_all(t, '(?s)(.*?)({p})', {g}))"
        found.append(
            f"SELECT r, {k} AS k, '{kind}' AS kind, {least} AS least, {part(1)} AS gap, {part(2)} AS hit, {part(group + 2)} AS checked, generate_subscripts(regexp_extract_all(t, '(?s)(.*?)({p})', 2), 1) AS i "
            f"FROM d WHERE regexp_matches(t, '{p}')"
        )
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  {" UNION ALL ".join(found)}),
s AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY r, k ORDER BY i) AS e FROM m),
w AS (
  SELECT r, k, e - length(hit) AS b, kind || ':' || (e - length(hit))::BIGINT || ':' || e::BIGINT AS span FROM s WHERE length(checked) >= least),
g AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(span, ',' ORDER BY b, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY b, k) AS spans
  FROM w GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""


SECRETS = _secrets()
