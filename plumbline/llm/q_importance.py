from plumbline.llm.common import documents
from plumbline.llm.importance import importance_resample
from plumbline.llm.queries import query
from plumbline.llm.sql import crc32

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH w AS (
  SELECT doc_id, false AS aim, {WORDS} AS ws FROM documents UNION ALL SELECT NULL, true, {WORDS} FROM benchmark
),
n AS (SELECT row_number() OVER () AS r, * FROM w),
f AS (
  SELECT r, aim, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS x FROM n
),
known AS MATERIALIZED (SELECT x, {crc32('x')} % 10000 AS bucket FROM (SELECT DISTINCT x FROM f)),
met AS (SELECT r, aim, bucket, count(*) AS k FROM f JOIN known USING (x) GROUP BY 1, 2, 3),
totals AS (SELECT bucket, coalesce(sum(k) FILTER (NOT aim), 0)::DOUBLE AS s, coalesce(sum(k) FILTER (aim), 0)::DOUBLE AS t FROM met GROUP BY 1),
whole AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM totals),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS gain FROM totals, whole),
weighted AS (SELECT r, floor(sum(gain * k) / sum(k))::BIGINT AS weight FROM met JOIN gains USING (bucket) WHERE NOT aim GROUP BY r),
scored AS (
  SELECT n.r, doc_id, len(ws) AS n_words, (len(ws) + greatest(len(ws) - 1, 0))::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM n LEFT JOIN weighted USING (r) WHERE NOT aim
),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS eligible FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= eligible * 25 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""


@query("op12_importance_resample", SQL)
def op12(spark, folder):
    return importance_resample(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
