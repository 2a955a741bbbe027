from plumbline.llm.common import documents
from plumbline.llm.near_dedup import near_dedup
from plumbline.llm.queries import query

SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+') AS ws FROM documents
),
s AS (
  SELECT DISTINCT doc_id, md5_number(array_to_string(ws[i:i + 2], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [1] ELSE range(1, len(ws) - 1) END) AS i FROM w)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
),
reach AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT link.a, reach.c FROM reach JOIN link ON link.b = reach.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id, w.doc_id = r.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM reach GROUP BY a) r ON r.a = w.doc_id
"""


@query("op1_near_dedup", SQL)
def op1(spark, folder):
    return near_dedup(documents(spark, folder), words=3, percent=85)
