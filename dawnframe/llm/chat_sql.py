"""SQL for the chat query: the same collapse over whole turn lists instead of hashes."""


def _safe(column: str) -> str:
    return f"replace(replace(coalesce({column}, ''), '<|im_start|>', '<|im_start |>'), '<|im_end|>', '<|im_end |>')"


COLLAPSE = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text, md5(text) AS digest, coalesce(CAST(floor(turn / 1024.0) AS BIGINT), -(1::BIGINT << 62)) AS chunk
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, digest NULLS FIRST) AS l
  FROM t GROUP BY conv_id
), u AS (
  SELECT min(conv_id) AS conv_id, l, count(*) AS n_copies FROM c GROUP BY l
), p AS (
  SELECT DISTINCT list_slice(l, 1, n) AS l FROM (SELECT l, unnest(range(1, len(l))) AS n FROM u)
), k AS (
  SELECT u.* FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = u.l)
), n AS (
  SELECT t.*, (row_number() OVER (PARTITION BY conv_id, chunk ORDER BY turn NULLS FIRST, role NULLS FIRST, digest NULLS FIRST) - 1) // 2000 AS piece
  FROM t
), parts AS (
  SELECT conv_id, chunk, piece, string_agg('<|im_start|>' || regexp_replace({_safe("role")}, '[\\r\\n]', ' ', 'g') || chr(10) || {_safe("text")} || '<|im_end|>', chr(10)
    ORDER BY turn NULLS FIRST, role NULLS FIRST, digest NULLS FIRST) AS rendered
  FROM n GROUP BY conv_id, chunk, piece
)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY chunk, piece) - 1 AS BIGINT) AS part,
  CAST(count(*) OVER (PARTITION BY conv_id) AS BIGINT) AS n_parts, CAST(len(l) AS BIGINT) AS n_turns, CAST(n_copies AS BIGINT) AS n_copies, rendered
FROM parts JOIN k USING (conv_id)
"""
