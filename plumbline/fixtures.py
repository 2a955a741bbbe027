"""Rows derived from the given tables, written once in SQL both engines read.

`@name` stands for a fixture or a table. The text has no backslashes so that it means the same everywhere.
"""

import re

from plumbline.operators import scale
from plumbline.plans.governed import DIMENSIONS, METRICS


def _q(v):
    return "'" + str(v).replace("'", "''") + "'"


def values(rows, names):
    body = ", ".join("(" + ", ".join(v if v in ("true", "false") else _q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({', '.join(names)})"


METRIC_IDS = "|".join(m["metric_id"] for m in METRICS)
NAMES_A = "|".join(m["aliases"][0] for m in METRICS)
NAMES_B = "|".join(m["aliases"][1] for m in METRICS)
NAMES_CJK = "|".join(m["aliases"][2] for m in METRICS)
DIM_IDS = "|".join(d["dimension_id"] for d in DIMENSIONS)
DIM_NAMES = "|".join(d["aliases"][0] for d in DIMENSIONS)
DIM_CJK = "|".join(d["aliases"][-1] for d in DIMENSIONS)


def pick(options, index):
    n = options.count("|") + 1
    return f"split_part('{options}', '|', CAST(1 + ({index}) % {n} AS INT))"


M, D1, D2 = "CAST(floor(o_orderkey / 12) AS BIGINT)", "CAST(floor(o_orderkey / 108) AS BIGINT)", "CAST(floor(o_orderkey / 5) AS BIGINT)"
ALIAS = f"CASE WHEN o_orderkey % 2 = 0 THEN {pick(NAMES_A, M)} ELSE {pick(NAMES_B, M)} END"

FIX = {}

FIX["requests"] = f"""
SELECT o_orderkey AS request_id, concat('case_', CAST(o_orderkey AS STRING)) AS case_id, tpl, g_metric, d1, d2,
  CASE tpl
   WHEN 0 THEN concat('What was the ', alias, '?')
   WHEN 1 THEN concat(upper(substr(alias, 1, 1)), substr(alias, 2), ' by ', n1)
   WHEN 2 THEN concat(alias, '  by ', n1, ' and ', n2)
   WHEN 3 THEN concat('Monthly ', alias)
   WHEN 4 THEN concat('Quarterly ', alias, ' by ', n1)
   WHEN 5 THEN concat('Show ', alias, ' per ', n1, ' in 1997')
   WHEN 6 THEN concat(n1, ' breakdown for ', alias)
   WHEN 7 THEN concat('按', c1, '统计', cm)
   WHEN 8 THEN concat(alias, ' grouped by ', n1, ', ', n2)
   WHEN 9 THEN CASE o_orderkey % 5 WHEN 0 THEN 'SELECT * FROM orders' WHEN 1 THEN 'drop table lineitem' WHEN 2 THEN 'Email of every buyer'
        WHEN 3 THEN 'What is the weather tomorrow?' ELSE 'show me the numbers' END
   WHEN 10 THEN concat(alias, ' across ', n1, ' in 2020')
   ELSE concat(CASE WHEN CAST(floor(o_orderkey / 12) AS BIGINT) % 3 = 0 THEN 'unselected ' ELSE '' END, alias, ' last year by ', n2) END AS nl_query
FROM (SELECT o_orderkey, o_orderkey % 12 AS tpl, {pick(METRIC_IDS, M)} AS g_metric, {ALIAS} AS alias,
   {pick(NAMES_CJK, M)} AS cm, {pick(DIM_IDS, D1)} AS d1, {pick(DIM_IDS, D2)} AS d2, {pick(DIM_NAMES, D1)} AS n1,
   {pick(DIM_NAMES, D2)} AS n2, {pick(DIM_CJK, D1)} AS c1 FROM @orders) b"""

# Gold labels use the same arithmetic and never read a decision.
FIX["labelled"] = """
SELECT request_id, case_id, nl_query, tpl, g_metric,
  CASE WHEN refuse THEN 'refuse' ELSE 'answer' END AS expected_action,
  CASE WHEN refuse THEN '' ELSE g_metric END AS expected_metric_id,
  CASE WHEN refuse OR tpl = 0 THEN '' WHEN tpl = 3 THEN 'month' WHEN tpl = 4 THEN
     CASE WHEN d1 = 'quarter' OR d1 = 'year' THEN 'quarter' WHEN d1 = 'month' THEN 'month' WHEN d1 < 'quarter' THEN concat(d1, '|quarter') ELSE concat('quarter|', d1) END
   WHEN tpl IN (2, 8) THEN CASE WHEN d1 = d2 THEN d1 WHEN d1 < d2 THEN concat(d1, '|', d2) ELSE concat(d2, '|', d1) END
   WHEN tpl = 11 THEN d2 ELSE d1 END AS expected_dims,
  CASE WHEN tpl = 5 THEN '1997' ELSE '2000' END AS expected_time_window,
  CASE WHEN refuse THEN 'policy_refusal' WHEN tpl = 0 THEN 'flat' WHEN tpl IN (2, 8) THEN 'multi' ELSE 'single' END AS query_family
FROM (SELECT *, (tpl IN (9, 10) OR g_metric = 'profit_margin') AS refuse FROM @requests) r"""
FIX["gold"] = "SELECT request_id, case_id, expected_action, expected_metric_id, expected_dims, expected_time_window, query_family FROM @labelled l"

# One prediction per request and mode; an error every p-th request of the mode.
FIX["predictions"] = f"""
SELECT mode, request_id, case_id, nl_query,
  CASE WHEN (request_id + p) % (3 * p) = 0 THEN CASE WHEN expected_action = 'answer' THEN 'refuse' ELSE 'answer' END ELSE expected_action END AS action,
  CASE WHEN (request_id + p) % (3 * p) = 0 THEN CASE WHEN expected_action = 'answer' THEN '' ELSE g_metric END
       WHEN request_id % (2 * p) = 1 AND expected_action = 'answer' THEN {pick(METRIC_IDS, 'request_id')} ELSE expected_metric_id END AS pred_metric_id,
  CASE WHEN (request_id + p) % (3 * p) = 0 AND expected_action = 'answer' THEN ''
       WHEN request_id % p = 2 AND expected_dims <> '' AND NOT (expected_dims LIKE '%priority%') THEN concat(expected_dims, '|priority') ELSE expected_dims END AS pred_dims,
  (request_id % 17 <> 3) AS execute_ok, CAST(1 + (request_id * 7919) % 5003 AS DOUBLE) / 10 AS latency_ms,
  CAST(100 + request_id % 37 AS BIGINT) AS prompt_tokens, CAST(10 + request_id % 11 AS BIGINT) AS completion_tokens
FROM (SELECT *, CASE mode WHEN 'compiled' THEN 29 WHEN 'guarded' THEN 7 ELSE 4 END AS p
      FROM (SELECT *, EXPLODE['compiled', 'guarded', 'schema'] AS mode FROM @labelled l) e) m"""

FIX["scored"] = """
SELECT p.mode, p.request_id, p.case_id, p.nl_query, p.action, p.pred_metric_id, p.pred_dims, p.execute_ok, p.latency_ms, p.prompt_tokens, p.completion_tokens,
  g.expected_action, g.expected_metric_id, g.expected_dims, g.query_family
FROM @predictions p JOIN @gold g ON p.request_id = g.request_id"""

# Replies of a model: a whole object, fenced, after a thought, broken, inside prose, refused with noise around.
FIX["replies"] = """
SELECT request_id, case_id, g_metric, obj, CASE request_id % 6
   WHEN 0 THEN obj
   WHEN 1 THEN concat('```json', chr(10), obj, chr(10), '```')
   WHEN 2 THEN concat('<think>maybe {"action": "none"}</think> ', obj)
   WHEN 3 THEN concat('{"action": "answer", "metric_id": "', g_metric, '", "dimensions": [')
   WHEN 4 THEN concat('The plan is ', obj, ' as asked.')
   ELSE concat('First {"draft": 1} then ', obj) END AS raw_response
FROM (SELECT request_id, case_id, g_metric, concat('{"action": "', CASE WHEN tpl = 9 THEN ' Refuse' WHEN tpl = 10 THEN 'maybe' ELSE 'answer' END,
   '", "metric_id": "', g_metric, ' ", "dimensions": ["', d1, '", " ", "', d2, '"], "time_window": "1997", "reason": "by rule"}') AS obj FROM @requests r) o"""


# Repair rounds of each request: up to four, better with every round.
FIX["rounds"] = f"""
SELECT request_id, case_id, nl_query, query_family, round, expected_action, expected_metric_id, expected_dims,
 CASE WHEN ok THEN expected_action WHEN request_id % 3 = 1 THEN 'refuse' ELSE 'answer' END AS action,
 CASE WHEN ok THEN expected_metric_id WHEN request_id % 3 = 1 THEN '' ELSE {pick(METRIC_IDS, 'request_id + round')} END AS pred_metric_id,
 CASE WHEN ok THEN expected_dims WHEN request_id % 3 = 1 THEN '' ELSE 'brand' END AS pred_dims,
 CASE WHEN ok THEN '' WHEN request_id % 4 = 0 THEN 'metric_not_in_catalog' WHEN request_id % 4 = 1 THEN 'dimension_not_allowed|finest_grain_violation' WHEN request_id % 4 = 2 THEN 'missed_refusal' ELSE '' END AS violations,
 (request_id % 13 <> round) AS has_prediction, CAST(500 + (request_id * 31 + round) % 400 AS BIGINT) AS prompt_tokens, CAST(20 + request_id % 9 AS BIGINT) AS completion_tokens,
 CAST((request_id * 17 + round * 5) % 1000 AS DOUBLE) AS latency_ms
FROM (SELECT *, (request_id % 5 + round >= 3 AND request_id % 41 <> 0) AS ok FROM (SELECT *, EXPLODE[0, 1, 2, 3] AS round FROM @labelled l) e WHERE round <= request_id % 4) x"""
# Five sampled answers per request, three annotators per request, a logged attempt or two per request.
FIX["samples"] = f"""
SELECT request_id, case_id, query_family, sample_idx, expected_action, expected_metric_id, expected_dims,
 CASE WHEN v < 6 THEN expected_action WHEN v = 6 THEN 'refuse' ELSE 'answer' END AS action,
 CASE WHEN v < 6 THEN expected_metric_id WHEN v = 6 THEN '' ELSE {pick(METRIC_IDS, 'v')} END AS pred_metric_id, CASE WHEN v < 6 THEN expected_dims ELSE '' END AS pred_dims
FROM (SELECT *, (request_id * 13 + sample_idx * sample_idx * (request_id % 7)) % 9 AS v FROM (SELECT *, EXPLODE[0, 1, 2, 3, 4] AS sample_idx FROM @labelled l) e) x"""
FIX["annotations"] = f"""
SELECT request_id, case_id, query_family, annotator, expected_action, expected_metric_id, expected_dims, CASE WHEN flip THEN CASE WHEN expected_action = 'answer' THEN 'refuse' ELSE 'answer' END ELSE expected_action END AS action,
 CASE WHEN flip THEN CASE WHEN expected_action = 'answer' THEN '' ELSE 'units' END WHEN expected_action = 'answer' AND request_id % 23 = 5 THEN 'units' ELSE expected_metric_id END AS metric,
 CASE WHEN flip THEN '' ELSE expected_dims END AS dims, CASE WHEN request_id % 19 = 2 THEN 'y' ELSE '' END AS uncertain, split_part('A|B|C|D|E', '|', CAST(1 + (request_id + CASE WHEN flip THEN 1 ELSE 0 END) % 5 AS INT)) AS option
FROM (SELECT *, ((request_id * (CASE annotator WHEN 'A' THEN 3 WHEN 'B' THEN 5 ELSE 7 END)) % 29 < 2) AS flip FROM (SELECT *, EXPLODE['A', 'B', 'C'] AS annotator FROM @labelled l) e) x"""
FIX["attempts"] = """
SELECT request_id, case_id, query_family, seq, CASE WHEN (request_id + seq) % 3 = 0 THEN 'timeout' ELSE '' END AS error, concat('reply ', CAST(request_id * 10 + seq AS STRING)) AS reply,
 concat('2024-01-0', CAST(1 + seq AS STRING), 'T00:', CAST(10 + request_id % 50 AS STRING), ':00Z') AS ts_utc FROM (SELECT *, EXPLODE[0, 1, 2] AS seq FROM @labelled l) e WHERE request_id % 11 <> 10 AND seq <= request_id % 4"""


# A large metric catalog: one metric per part, with evidence that is complete for some and not for others.
FIX["part_metrics"] = """
SELECT p_partkey, concat('m_', CAST(p_partkey AS STRING)) AS metric_id, p_brand AS domain_id,
 CASE p_partkey % 5 WHEN 0 THEN concat('SUM(a', CAST(p_size AS STRING), ')') WHEN 1 THEN 'SUM(num_x) / NULLIF(SUM(den_x), 0)' WHEN 2 THEN 'SUM(sales) / 1' WHEN 3 THEN '' ELSE 'COUNT(*)' END AS formula,
 CASE WHEN p_partkey % 7 = 0 THEN 'ratio' ELSE 'additive' END AS metric_type, (p_partkey % 6 = 0) AS scoped_ratio,
 CASE WHEN p_partkey % 10 = 3 THEN 'SUM(top)' ELSE '' END AS numerator, CASE WHEN p_partkey % 20 = 3 THEN 'COUNT(bottom)' ELSE '' END AS denominator,
 CASE WHEN p_partkey % 12 = 0 THEN concat('n', CAST(p_size % 10 AS STRING), '|n', CAST((p_size + 1) % 10 AS STRING)) ELSE '' END AS numerator_nodes,
 CASE WHEN p_partkey % 12 = 0 THEN concat('d', CAST(p_size % 10 AS STRING)) ELSE '' END AS denominator_nodes,
 CASE WHEN p_partkey % 3 = 0 THEN concat('n', CAST(p_size % 10 AS STRING), '|d', CAST(p_size % 10 AS STRING)) ELSE '' END AS coverage_nodes,
 (p_partkey % 9 = 4) AS coverage_required, (p_partkey % 13 <> 5) AS answerable,
 CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'region|nation|month' WHEN 2 THEN 'brand' ELSE 'region|brand|segment|quarter' END AS allowed_dimensions
FROM @part"""
FIX["part_edges"] = """
SELECT concat('n', CAST(p_size % 10 AS STRING)) AS src, metric_id AS dst, 'numerator_of' AS edge_type, CASE WHEN p_partkey % 4 = 1 THEN metric_id END AS metric_id, domain_id
 FROM (SELECT m.*, p.p_size FROM @part_metrics m JOIN @part p ON m.p_partkey = p.p_partkey) a WHERE p_partkey % 8 <> 4
UNION ALL SELECT concat('n', CAST((p_size + 1) % 10 AS STRING)), metric_id, 'numerator_of', metric_id, domain_id
 FROM (SELECT m.*, p.p_size FROM @part_metrics m JOIN @part p ON m.p_partkey = p.p_partkey) b WHERE p_partkey % 24 <> 0
UNION ALL SELECT concat('d', CAST(p_size % 10 AS STRING)), metric_id, 'denominator_of', CASE WHEN p_partkey % 36 = 0 THEN 'm_other' ELSE metric_id END, domain_id
 FROM (SELECT m.*, p.p_size FROM @part_metrics m JOIN @part p ON m.p_partkey = p.p_partkey) c WHERE p_partkey % 10 <> 6
UNION ALL SELECT metric_id, 'region', 'measures_of', metric_id, domain_id FROM @part_metrics d"""
FIX["part_bindings"] = """
SELECT concat('b', CAST(p_partkey AS STRING), '_', side) AS binding_id, metric_id, domain_id, concat(side, CAST(p_size % 10 AS STRING)) AS dependency_node_id,
 CASE WHEN p_partkey % 45 = 0 THEN NULL WHEN p_partkey % 21 = 0 THEN 'phys_lost' ELSE concat('phys_', CAST(p_size % 10 AS STRING)) END AS physical_node_id
FROM (SELECT m.metric_id, m.domain_id, m.p_partkey, p.p_size, EXPLODE['n', 'd'] AS side FROM @part_metrics m JOIN @part p ON m.p_partkey = p.p_partkey) x
WHERE NOT (side = 'd' AND p_partkey % 15 = 0)"""
FIX["part_coverage"] = """
SELECT DISTINCT p_brand AS domain_id, concat('phys_', CAST(p_size % 10 AS STRING)) AS semantic_node_id FROM @part WHERE p_size < 40
UNION SELECT DISTINCT p_brand, concat('n', CAST(p_size % 10 AS STRING)) FROM @part WHERE p_size % 3 <> 0
UNION SELECT DISTINCT p_brand, concat('d', CAST(p_size % 10 AS STRING)) FROM @part WHERE p_size % 4 <> 0"""


def expand(sql, table):
    """Replace every @name: fixtures inline as subqueries, tables through `table`."""

    def sub(m):
        name = m.group(1)
        return f"({expand(FIX[name], table)})" if name in FIX else table(name)

    return re.sub(r"@(\w+)", sub, sql)


def duck(sql):
    sql = re.sub(r"EXPLODE\[([^\]]*)\]", r"unnest([\1])", expand(sql, lambda t: t))
    return re.sub(r"\bSTRING\b", "VARCHAR", sql)


def spark_sql(sql, folder):
    sql = expand(sql, lambda t: f"parquet.`{folder}/{t}.parquet`")
    return re.sub(r"EXPLODE\[([^\]]*)\]", r"explode(array(\1))", sql)


class Tables:
    """The given tables of one folder and the fixtures derived from them."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name):
        return self.fx(name) if name in FIX else self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def fx(self, name):
        return self.sql(FIX[name])

    def sql(self, text):
        df = self.spark.sql(spark_sql(text, self.folder))
        # a made-up text is a large expression; compute it once, as a stored column would be
        return scale.fenced(df, "nl_query") if "nl_query" in df.columns else df

    def spread(self, text, key="request_id"):
        """Rows of a fixture or a SQL text dealt over the cores."""
        if " " in text:
            return scale.spread(self.sql(text), key)
        return scale.spread(getattr(self, text), key)
