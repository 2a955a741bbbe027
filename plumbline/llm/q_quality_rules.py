from plumbline.llm.common import documents
from plumbline.llm.queries import query
from plumbline.llm.quality_rules import quality_rules

SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \t\n\v\f\r]+') AS ws FROM t),
win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)
),
hot AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hot) GROUP BY doc_id),
cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM t),
line AS (SELECT doc_id, j, ls[j] AS l, regexp_extract_all(ls[j], '[^ \t\n\v\f\r]+') AS ws FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS j FROM cut)),
judged AS (
  SELECT doc_id, len(array_to_string(ws, '')) AS chars, row_number() OVER (PARTITION BY doc_id, l ORDER BY j) > 1 AS dup,
    (len(ws) > 2 AND 5 * len(list_filter(ws, lambda x: x IN ('|', '»', '•', '·', '>'))) >= len(ws))
    OR 10 * len(regexp_extract_all(l, '[#*$%&|<>]')) >= len(array_to_string(ws, ''))
    OR 2 * len(regexp_extract_all(l, '!!')) >= len(ws)
    OR (len(ws) >= 10 AND NOT regexp_matches(l, '[.!?…]'))
    OR regexp_matches(l, '(?i)accept (all )?cookies|use of cookies|privacy policy|terms of (use|service)|all rights reserved|click here|subscribe to our|enable javascript|skip to content') AS bad
  FROM line WHERE len(ws) > 0
),
docs AS (SELECT doc_id, sum(dup::INT) AS dups, sum(chars) AS chars, sum(CASE WHEN dup OR bad THEN chars ELSE 0 END) AS lost FROM judged GROUP BY doc_id),
facts AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_lost
  FROM w LEFT JOIN docs USING (doc_id) LEFT JOIN rep USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_lost <= 50 * word_chars AS kept
FROM facts
"""


@query("op9_quality_rules", SQL)
def op9(spark, folder):
    return quality_rules(documents(spark, folder))
