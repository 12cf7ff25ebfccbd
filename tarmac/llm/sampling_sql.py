"""DuckDB SQL of the resampling and clustering queries, from the raw tables."""

from __future__ import annotations

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hex(text: str, digits: str) -> str:
    """Value of the hexadecimal digits in ``text``."""
    return (f"list_reduce([CAST(0 AS BIGINT)] || list_transform(range(1, length({text}) + 1), "
            f"lambda i: CAST(strpos('{digits}', substr({text}, i, 1)) - 1 AS BIGINT)), lambda a, b: 16 * a + b)")


def _words(table: str) -> str:
    return (f"SELECT row_number() OVER () AS rid, *, "
            f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM {table}")


OP11_SQL = f"""
WITH tab AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce([CAST(n AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
d AS ({_words("documents")}),
q AS ({_words("benchmark")}),
dw AS (SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(w) AS word FROM d) GROUP BY ALL),
qw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM q) GROUP BY ALL),
names AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM qw)),
crc AS (
  SELECT word, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(0, CAST(length(h) / 2 AS BIGINT)),
             lambda i: CAST(16 * strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1))
                            + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 17 AS BIGINT)),
           lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 10000 AS bucket
  FROM names, tab),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN crc USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM qw JOIN crc USING (word) GROUP BY bucket),
tot AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS s_all, coalesce((SELECT sum(t) FROM t), 0) AS t_all),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (s_all + 10000) AS DOUBLE)
                                      / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (bucket), tot),
sums AS (SELECT rid, sum(n * g) AS total FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY rid),
weighed AS (
  SELECT rid, doc_id, len(w) AS n, substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS x,
         CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END AS weight
  FROM d LEFT JOIN sums USING (rid)),
scored AS (
  SELECT rid, doc_id, n, CAST(weight AS BIGINT) AS weight,
         CAST(weight AS BIGINT) + CAST(floor(-1000 * ln(-ln(({_hex("x", "0123456789abcdef")} + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM weighed),
ranked AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER () AS n_all
  FROM scored WHERE n >= 20)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score,
       CASE WHEN r <= 10 * n_all // 100 THEN CAST(r AS BIGINT) END AS rank
FROM scored LEFT JOIN ranked USING (rid)
"""


def _round(k: int) -> str:
    """Assignment to the centroids of round ``k`` and the centroids after it."""
    far = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))"
    return f"""
p{k} AS MATERIALIZED (SELECT rid, c, CAST({far} AS BIGINT) AS far FROM x, c{k}),
a{k} AS MATERIALIZED (
  SELECT rid, CAST(best[2] AS BIGINT) AS c, CAST(best[1] AS BIGINT) AS far
  FROM (SELECT rid, min([far, c]) AS best FROM p{k} GROUP BY rid)),
s{k} AS (
  SELECT c, i, sum(e) AS s, count(*) AS n
  FROM (SELECT c, unnest(v) AS e, unnest(range(1, 65)) AS i FROM a{k} JOIN x USING (rid)) GROUP BY c, i),
c{k + 1} AS MATERIALIZED (
  SELECT c, coalesce(mean, m) AS m FROM c{k} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS mean FROM s{k} GROUP BY c) USING (c))"""


OP12_SQL = f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS BIGINT) AS c, v AS m
  FROM (SELECT v, sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM x ORDER BY h LIMIT 8)),
{",".join(_round(k) for k in range(11))}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, far AS distance, CAST(sum(far) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(far) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a10 JOIN x USING (rid) JOIN c10 USING (c)
"""
