"""SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from paperloom.llm.url_filter import SOFT, SOFT_THRESHOLD, STRICT

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LINE_DEDUP = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, md5(coalesce(text, '')) AS k,
         CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
w AS (
  SELECT doc_id, k, i, lines[i + 1] || chr(10) || lines[i + 2] || chr(10) || lines[i + 3] AS three
  FROM (SELECT DISTINCT doc_id, k, lines, unnest(range(0, len(lines) - 2)) AS i FROM d)),
ranked AS (
  SELECT doc_id, k, i, row_number() OVER (PARTITION BY three ORDER BY doc_id, i) AS r
  FROM w WHERE trim(translate(three, chr(10) || chr(9) || chr(13), '   ')) <> ''),
gone AS (
  SELECT doc_id, k, list_sort(list_distinct(list(i + o))) AS removed
  FROM ranked, (SELECT unnest([0, 1, 2]) AS o) WHERE r > 1 GROUP BY doc_id, k)
SELECT d.doc_id, n AS n_lines, coalesce(len(removed), 0) AS n_removed,
       md5(coalesce(array_to_string(removed, ','), '')) AS removed_md5,
       md5(CASE WHEN removed IS NULL THEN body ELSE coalesce(array_to_string(
         list_transform(list_filter(range(0, len(lines)), lambda x: NOT list_contains(removed, x)),
                        lambda x: lines[x + 1]), chr(10)), '') END) AS text_md5
FROM d LEFT JOIN gone USING (doc_id, k)
"""


def _hit(term: str) -> str:
    return f"regexp_matches(u, '(^|[^a-z0-9]){term}($|[^a-z0-9])')"


_URL_FILTER = f"""
WITH a AS (
  SELECT page_id, {_LOWER.format("url")} AS u,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
b AS (
  SELECT page_id, u, {_LOWER.format("regexp_extract(coalesce(rest, ''), '^[^/?#]*')")} AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM a),
r(verdict, h, p) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
c AS (
  SELECT page_id, max_by(h || p, len(h || p)) AS rule, max_by(r.verdict, len(h || p)) AS verdict
  FROM b JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id)
SELECT page_id, host, path, rule,
       coalesce(c.verdict, CASE WHEN {" OR ".join(map(_hit, STRICT))}
         OR {" + ".join(f"{w} * {_hit(t)}::INT" for t, w in SOFT.items())} >= {SOFT_THRESHOLD}
         THEN 'block' ELSE 'allow' END) AS verdict
FROM b LEFT JOIN c USING (page_id)
"""

_FILL_MIDDLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
e AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a,
         ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
f AS (
  SELECT *, substr(t, 1, least(a, b)) AS p, substr(t, greatest(a, b) + 1) AS s,
         substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m
  FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM f
"""

_HARD_NEGATIVES = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v,
         row_number() OVER () AS place
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.place AS anchor, b.place, b.vec_id, a.label = b.label AS same,
         list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.place <> b.place),
p AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS nth
    FROM s WHERE same)
  WHERE nth <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id,
         s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same
    AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 10
"""

ORACLES = {
    "op11_hard_negatives": _HARD_NEGATIVES,
    "op7_line_dedup": _LINE_DEDUP,
    "op10_url_filter": _URL_FILTER,
    "op13_fill_in_middle": _FILL_MIDDLE,
}
