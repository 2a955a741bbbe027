from pyspark.sql import functions as F

from plumbline.llm.queries import query
from plumbline.llm.url_filter import url_filter

#: The contract's rules.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

DRAWN = "greatest(0.001, least(0.999, coalesce(sum(power(bad - n * mean, 2) - n * (mean * (1 - mean))) OVER () / nullif(sum(n * (n - 1) * (mean * (1 - mean))) OVER (), 0), 0.001)))"

SQL = rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_replace(substr(url, strpos(url, '://') + 3), '(?s)[?#].*$', '') ELSE '' END AS rest FROM pages
),
u AS (
  SELECT page_id, translate(CASE WHEN rest LIKE '%/%' THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN rest LIKE '%/%' THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM cut
),
told AS (SELECT doc_id AS page_id, max((coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1)::INT) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
hosts AS (
  SELECT host, count(told.bad)::DOUBLE AS n, coalesce(sum(told.bad), 0)::DOUBLE AS bad, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), '[.]?(:[0-9]*)?$', ''), '.') AS p
  FROM u LEFT JOIN told USING (page_id) GROUP BY host
),
named AS (
  SELECT host, n, bad, array_to_string(p, '.') AS bare, p, regexp_matches(array_to_string(p, '.'), '^[0-9]+([.][0-9]+){{3}}$') OR host LIKE '[%' AS ip,
    CASE WHEN len(p) > 2 AND len(p[-1]) = 2 AND p[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS k
  FROM hosts
),
h AS (
  SELECT host, n, bad, CASE WHEN ip OR len(p) <= k THEN bare ELSE array_to_string(p[len(p) - k:], '.') END AS domain,
    CASE WHEN ip THEN bare ELSE array_to_string(p[len(p) - k + 1:], '.') END AS suffix
  FROM named
),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY 1),
s1 AS (SELECT *, CASE WHEN sum(n) OVER () > 0 THEN (sum(bad) OVER () + 0.5) / (sum(n) OVER () + 1.0) ELSE 0.0 END AS mean FROM s),
s2 AS (SELECT *, 1 / {DRAWN} - 1 AS k FROM s1),
s3 AS (SELECT suffix, (k * mean + bad) / (k * mean + bad + k * (1 - mean) + n - bad) AS mean FROM s2),
d2 AS (SELECT domain, n, bad, mean, 1 / {DRAWN} - 1 AS k FROM d JOIN s3 USING (suffix)),
d3 AS (SELECT domain, (k * mean + bad) / (k * mean + bad + k * (1 - mean) + n - bad) AS mean FROM d2),
h2 AS (SELECT host, n, bad, mean, 1 / {DRAWN} - 1 AS k FROM h JOIN d3 USING (domain)),
h3 AS (SELECT host, n, bad, k * mean + bad AS a, k * (1 - mean) + n - bad AS b FROM h2),
known AS (SELECT host, n, bad, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM h3),
rules AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) r(name, start, says)),
fits AS (
  SELECT page_id, host, path, name || start AS rule, says,
    row_number() OVER (PARTITION BY host, path ORDER BY len(name || start) DESC, len(name) DESC, name || start) AS r
  FROM (SELECT DISTINCT NULL::BIGINT AS page_id, host, path FROM u) JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.says, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  n::BIGINT AS host_labelled, known.bad::BIGINT AS host_bad, floor(bound * 1000)::BIGINT AS host_bound_milli
FROM u JOIN known ON u.host = known.host LEFT JOIN (SELECT * FROM fits WHERE r = 1) f ON u.host = f.host AND u.path = f.path
"""


@query("op13_url_filter", SQL)
def op13(spark, folder):
    """A page is labelled by the row of `labels` with its number as doc_id; low quality and toxic are both bad."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    known = labels.filter(F.col("quality").isNotNull() | F.col("toxic").isNotNull())
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    return url_filter(spark.read.parquet(f"{folder}/pages.parquet"), known.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), RULES)
