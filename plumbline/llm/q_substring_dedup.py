from plumbline.llm.common import documents
from plumbline.llm.queries import query
from plumbline.llm.substring_dedup import substring_dedup

SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, hash(array_to_string(ws[i:i + 34], ' ')) AS g, md5(array_to_string(ws[i:i + 34], ' ')) AS m
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
),
hot AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g, m) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM hot)),
word AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
kept AS (
  SELECT word.doc_id, count(*) AS n_words, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY word.p) FILTER (WHERE gone.p IS NULL) AS t
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id
)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query("op7_substring_dedup", SQL)
def op7(spark, folder):
    return substring_dedup(documents(spark, folder), window=35)
