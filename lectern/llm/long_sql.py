"""DuckDB SQL of the longer oracles."""

from __future__ import annotations

SUFFIXES = r"""
WITH b AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, octet_length(b) - 398)) AS s, b FROM b WHERE octet_length(b) >= 400
), w AS (
  SELECT doc_id, s, md5(b[s:s + 399]) AS h FROM s
), r AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1
), o AS (
  SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400, true)::INT AS o FROM r
), g AS (
  SELECT doc_id, s, sum(o) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM o
), spans AS (
  SELECT doc_id, g, min(s) AS a, max(s) + 400 AS z FROM g GROUP BY ALL
), n AS (
  SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
), cut AS (
  SELECT doc_id, z AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM spans
  UNION ALL SELECT doc_id, 1, min(a) FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, unhex(string_agg(hex(b[a:coalesce(z - 1, octet_length(b))]), '' ORDER BY a)) AS k
  FROM cut JOIN b USING (doc_id) WHERE a < coalesce(z, octet_length(b) + 1) GROUP BY doc_id
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN n_removed IS NULL THEN b ELSE coalesce(k, ''::BLOB) END) AS kept_sha256
FROM b LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _leaf(text: str) -> str:
    parts = [(text if f == "text" else f"{f}::VARCHAR") for f in _FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"


MERKLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
    CASE WHEN list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]))),
      lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384::UBIGINT)) % 2 = 1 THEN {_leaf("replace(text, chr(10), '')")} END AS changed
  FROM documents
), l AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d
), t AS (
  SELECT 0 AS lv, source, i, leaf AS h, n FROM l
  UNION ALL
  SELECT lv + 1, source, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3) FROM t WHERE n > 1 GROUP BY lv, source, i // 3
), s AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
  SELECT 0 AS lv, i, subroot AS h, n FROM s
  UNION ALL
  SELECT lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3) FROM u WHERE n > 1 GROUP BY lv, i // 3
), f AS (
  SELECT leaf AS own, doc_id, source, 0 AS lv, i, n, coalesce(changed, leaf) AS x, '' AS proof FROM l
  UNION ALL
  SELECT own, doc_id, source, lv + 1, i // 3, (n + 2) // 3, sha256(coalesce(a, '') || x || coalesce(z, '')), proof || coalesce(a, '') || coalesce(z, '') FROM (
    SELECT f.*, (SELECT string_agg(h, '' ORDER BY t.i) FROM t WHERE t.lv = f.lv AND t.source IS NOT DISTINCT FROM f.source AND t.i // 3 = f.i // 3 AND t.i < f.i) AS a,
      (SELECT string_agg(h, '' ORDER BY t.i) FROM t WHERE t.lv = f.lv AND t.source IS NOT DISTINCT FROM f.source AND t.i // 3 = f.i // 3 AND t.i > f.i) AS z
    FROM f WHERE n > 1)
), e AS (
  SELECT own, doc_id, s.subroot, 0 AS lv, s.i, s.n, x, proof FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source WHERE f.n = 1
  UNION ALL
  SELECT own, doc_id, subroot, lv + 1, i // 3, (n + 2) // 3, sha256(coalesce(a, '') || x || coalesce(z, '')), proof || coalesce(a, '') || coalesce(z, '') FROM (
    SELECT e.*, (SELECT string_agg(h, '' ORDER BY u.i) FROM u WHERE u.lv = e.lv AND u.i // 3 = e.i // 3 AND u.i < e.i) AS a,
      (SELECT string_agg(h, '' ORDER BY u.i) FROM u WHERE u.lv = e.lv AND u.i // 3 = e.i // 3 AND u.i > e.i) AS z
    FROM e WHERE n > 1)
)
SELECT doc_id, own AS leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = r.h AS verified
FROM e, (SELECT h FROM u WHERE n = 1) r WHERE e.n = 1
"""


def _exponion(k: int, rounds: int, size: int) -> str:
    """Each round in turn: nearest centroid of every vector, then means, floored exactly."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}
)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v AS p FROM v QUALIFY c < {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT r, vec_id, v, c, p, list_sum(list_transform(list_zip(v, p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM v, c{n})")
        parts.append(f"a{n} AS MATERIALIZED (SELECT * FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1)")
        if n < rounds:
            parts.append(f"m{n} AS (SELECT c, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM (SELECT c, generate_subscripts(v, 1) AS j, unnest(v) AS x FROM a{n}) GROUP BY c, j)")
            parts.append(f"n{n} AS (SELECT c, list(x::BIGINT ORDER BY j) AS p FROM m{n} GROUP BY c)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(n{n}.p, c{n}.p) AS p FROM c{n} LEFT JOIN n{n} USING (c))")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, c::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(p, ',')) AS centroid_sha256
FROM a{rounds}
"""


EXPONION = _exponion(k=8, rounds=10, size=64)
