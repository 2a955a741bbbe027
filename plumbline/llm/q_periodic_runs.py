from plumbline.llm.common import documents
from plumbline.llm.periodic_runs import periodic_runs, planted
from plumbline.llm.queries import query
from plumbline.llm.sql import crc32

#: A run of period q and 4 q words has doubled blocks: words at k q, k q + q and k q + 2 q are the same for some k.
SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+') AS ws, coalesce(doc_id::VARCHAR, '') AS key FROM documents
),
h AS (SELECT *, {crc32('key')} AS h, len(ws) AS n FROM t),
g AS (SELECT *, h // 10 AS g, (h // 10) % greatest(n, 1) AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
w AS MATERIALIZED (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(ws[1:a], list_transform(range(n - a), lambda i: ws[a + i % p + 1])) ELSE ws END AS ws FROM p
),
probe AS (SELECT r, n, ws, unnest(range(1, n // 4 + 1)) AS q FROM w),
hit AS (
  SELECT r, n, ws, q FROM probe
  WHERE len(list_filter(range(n // q - 2), lambda k: ws[k * q + 1] = ws[k * q + q + 1] AND ws[k * q + q + 1] = ws[k * q + 2 * q + 1])) > 0
),
same AS (SELECT r, q, unnest(list_filter(range(n - q), lambda i: ws[i + 1] = ws[i + q + 1])) AS i FROM hit),
island AS (SELECT r, q, min(i) AS s, max(i) + 1 + q AS e FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS grp FROM same) GROUP BY r, q, grp),
long AS (SELECT * FROM island WHERE e - s >= greatest(6, 4 * q)),
run AS MATERIALIZED (SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.r = x.r AND y.q < x.q AND y.s <= x.s AND x.e <= y.e)),
told AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS told,
    first(struct_pack(s := s, len := e - s, q := q) ORDER BY e - s DESC, s, q) AS best
  FROM run GROUP BY r
),
gone AS (SELECT r, list(DISTINCT i) AS gone FROM (SELECT r, unnest(range(s + q, e)) AS i FROM run) GROUP BY r),
word AS (SELECT r, unnest(range(n)) AS i, unnest(ws) AS x FROM w SEMI JOIN gone USING (r)),
lost AS (SELECT r, unnest(gone) AS i FROM gone),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS kept FROM word ANTI JOIN lost USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.len::BIGINT AS length, best.q::BIGINT AS period,
  (1000 * best.len // best.q)::BIGINT AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256,
  sha256(CASE WHEN n_runs IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(kept, '') END) AS collapsed_sha256
FROM w LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""


@query("op11_periodic_runs", SQL)
def op11(spark, folder):
    return periodic_runs(documents(spark, folder), planted)
