"""Manifest conversion: every part defines a model with its measure and metrics."""

from pyspark.sql import functions as F

from plumbline.operators import manifest as MF
from plumbline.plans.governed import DIM_IDS
from plumbline.queries import query
from plumbline.queries.ct import LIST, part_metrics
from plumbline.queries.jn import PARENTS

S = lambda e: f"CAST({e} AS STRING)"
K = S("p_partkey")
BASE = f"CASE WHEN p_partkey % 4 = 0 THEN concat('amt_', {K}) ELSE concat('s_', {K}) END"
BASE_SIZE = f"CASE WHEN p_size % 4 = 0 THEN concat('amt_', {S('p_size')}) ELSE concat('s_', {S('p_size')}) END"
GRAIN = "split_part('hour|day|week|month|quarter|year', '|', CAST(1 + p_partkey % 6 AS INT))"
MODELS = f"SELECT concat('mod_', {K}) AS model, concat('e_', {K}) AS primary_entity, concat('tab_', {K}) AS physical, {GRAIN} AS agg_grain FROM @part"
ENTITIES = f"SELECT concat('mod_', {K}) AS model, concat('e_', {K}) AS entity, 'primary' AS type FROM @part UNION ALL SELECT concat('mod_', {K}), concat('e_', {S('p_size')}), 'foreign' FROM @part"
DIMENSIONS = f"SELECT concat('mod_', {K}) AS model, concat('kind_', lower(p_type)) AS name, CASE WHEN p_partkey % 5 = 1 THEN 'time' ELSE 'categorical' END AS type FROM @part"
MEASURES = f"SELECT concat('amt_', {K}) AS measure, concat('mod_', {K}) AS model, split_part('sum|count|count_distinct|average|weird|max|sum_boolean|percentile', '|', CAST(1 + p_partkey % 8 AS INT)) AS agg, 'x' AS expr, (p_partkey % 4 = 0) AS create_metric FROM @part"
RAW = f"""SELECT concat('s_', {K}) AS metric_id, 'simple' AS type, concat('amt_', {K}) AS measure, CASE WHEN p_partkey % 10 = 1 THEN 'month' END AS time_grain, '' AS expr, '' AS ins FROM @part WHERE p_partkey % 4 <> 0
 UNION ALL SELECT concat('c_', {K}), 'cumulative', '', NULL, '', '' FROM @part WHERE p_partkey % 17 = 0
 UNION ALL SELECT concat('r_', {K}), 'ratio', '', NULL, '', concat('numerator=', CASE WHEN p_partkey % 17 = 0 THEN concat('c_', {K}) ELSE {BASE} END, '|denominator=', {BASE_SIZE}) FROM @part
 UNION ALL SELECT concat('d_', {K}), 'derived', '', NULL, 'a / b - a', concat('a=r_', {K}, '|b=', {BASE}) FROM @part WHERE p_partkey % 2 = 0
 UNION ALL SELECT concat('dd_', {K}), 'derived', '', CASE WHEN p_partkey % 20 = 0 THEN 'quarter' END, 'x + y', concat('x=d_', {K}, '|y=r_', {K}) FROM @part WHERE p_partkey % 10 = 0"""

G = "['hour', 'day', 'week', 'month', 'quarter', 'year']"
FORMULA = "CASE agg WHEN 'sum' THEN 'SUM(x)' WHEN 'count' THEN 'COUNT(x)' WHEN 'count_distinct' THEN 'COUNT(DISTINCT x)' WHEN 'average' THEN 'AVG(x)' WHEN 'max' THEN 'MAX(x)' WHEN 'sum_boolean' THEN 'SUM(CAST(x AS INTEGER))' WHEN 'percentile' THEN 'PERCENTILE_CONT(x, 0.5)' END"


def combined(name, source, kind, expr):
    """One resolution level in SQL over inputs of the levels before it."""
    return f"""{name}_in AS (SELECT metric_id, time_grain, string_split(i, '=')[1] AS al, string_split(i, '=')[2] AS inp FROM (SELECT metric_id, time_grain, unnest(string_split(ins, '|')) AS i FROM raw WHERE metric_id LIKE '{name}\\_%' ESCAPE '\\')),
 {name}_j AS (SELECT i.metric_id, i.time_grain, bool_and(s.ok) AS ok, max(CASE WHEN grain = '' THEN 1 ELSE list_position({G}, grain) END) AS g0, list_sort(list_distinct(flatten(list(cov)))) AS cov, min(al || '=' || inp) AS i1, max(al || '=' || inp) AS i2,
   max(CASE WHEN al = 'numerator' THEN inp END) AS nn, max(CASE WHEN al = 'denominator' THEN inp END) AS dn, max(CASE WHEN al = 'numerator' THEN formula END) AS nf, max(CASE WHEN al = 'denominator' THEN formula END) AS df, max(CASE WHEN al = 'a' THEN inp END) AS ai, max(CASE WHEN al = 'b' THEN inp END) AS bi,
   list(allowed) AS al FROM {name}_in i JOIN ({source}) s ON s.metric_id = i.inp GROUP BY 1, 2),
 {name}_k AS (SELECT *, greatest(g0, coalesce(list_position({G}, time_grain), 1)) AS g, list_sort(list_intersect(al[1], al[2])) AS bth FROM {name}_j),
 {name} AS (SELECT metric_id, '{kind}' AS mtype, ok, CASE WHEN ok THEN {expr} ELSE '' END AS formula, CASE WHEN NOT ok THEN [] WHEN time_grain IS NULL THEN bth ELSE list_sort(list_concat(list_filter(bth, lambda d: NOT starts_with(d, 'metric_time__')), list_transform({G}[g:], lambda z: 'metric_time__' || z))) END AS allowed,
   CASE WHEN ok THEN {G}[g] ELSE '' END AS grain, CASE WHEN ok THEN cov ELSE [] END AS cov, {"nn" if kind == "ratio" else "CASE WHEN ok AND ai IS NOT NULL THEN ai ELSE '' END"} AS num, {"dn" if kind == "ratio" else "CASE WHEN ok AND ai IS NOT NULL THEN list_aggregate(list_sort(list_distinct([ai, bi])), 'string_agg', '|') ELSE '' END"} AS den FROM {name}_k)"""


SQL = f"""WITH raw AS ({RAW}), dims AS (SELECT d.model, e.primary_entity || '__' || name AS dim FROM ({DIMENSIONS}) d JOIN ({MODELS}) e USING (model) WHERE type = 'categorical'),
 reach AS (SELECT DISTINCT a.model, b.model AS r FROM ({ENTITIES}) a JOIN ({ENTITIES}) b ON a.entity = b.entity AND (b.type = 'primary' OR a.model = b.model)),
 cat AS (SELECT reach.model, list(DISTINCT dim) AS cat FROM reach JOIN dims ON dims.model = r GROUP BY 1),
 sm AS (SELECT metric_id, measure, time_grain FROM raw WHERE type = 'simple' UNION ALL SELECT measure, measure, NULL FROM ({MEASURES}) m WHERE create_metric),
 sj AS (SELECT metric_id, measure, {FORMULA} AS f, greatest(list_position({G}, agg_grain), coalesce(list_position({G}, time_grain), 1)) AS g, coalesce(cat, []) AS cat FROM sm JOIN ({MEASURES}) m USING (measure) JOIN ({MODELS}) o USING (model) LEFT JOIN cat USING (model)),
 s AS (SELECT metric_id, 'simple' AS mtype, f IS NOT NULL AS ok, coalesce(f, '') AS formula, CASE WHEN f IS NULL THEN [] ELSE list_sort(list_concat(cat, list_transform({G}[g:], lambda z: 'metric_time__' || z))) END AS allowed, {G}[g] AS grain, CASE WHEN f IS NULL THEN [] ELSE ['measure.' || measure] END AS cov, '' AS num, '' AS den FROM sj
   UNION ALL SELECT metric_id, 'cumulative', false, '', [], '', [], '', '' FROM raw WHERE type = 'cumulative'),
 {combined('r', 'SELECT * FROM s', 'ratio', "'(' || nf || ') / NULLIF((' || df || '), 0)'")},
 {combined('d', 'SELECT * FROM s UNION ALL SELECT * FROM r', 'derived', "'a / b - a'")},
 {combined('dd', 'SELECT * FROM r UNION ALL SELECT * FROM d', 'derived', "'x + y'")},
 c AS (SELECT * FROM s UNION ALL SELECT * FROM r UNION ALL SELECT * FROM d UNION ALL SELECT * FROM dd)"""


def contract(t):
    parts = F.transform(F.filter(F.split("ins", r"\|"), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("alias"), F.split_part(x, F.lit("="), F.lit(2)).alias("name")))
    raw = t.sql(RAW).withColumn("inputs", parts)
    return MF.contract_of_manifest(t.sql(MODELS), t.sql(ENTITIES), t.sql(DIMENSIONS), t.sql(MEASURES), raw)


J = lambda c: F.array_join(c, "|")


@query("ct_manifest_contract", SQL + " SELECT metric_id, mtype AS metric_type, ok AS answerable, formula, array_to_string(allowed, '|') AS allowed, grain, array_to_string(cov, '|') AS coverage, num, den FROM c")
def _(t):
    return contract(t).select("metric_id", "metric_type", "answerable", "formula", J("allowed").alias("allowed"), "grain", J("coverage").alias("coverage"), J("numerator_nodes").alias("num"), J("denominator_nodes").alias("den"))


@query("ct_manifest_edges", SQL + f""" SELECT 'measures_of' AS edge_type, metric_id AS src, unnest(allowed) AS dst FROM c UNION ALL SELECT 'numerator_of', num, metric_id FROM c WHERE num <> ''
 UNION ALL SELECT 'denominator_of', unnest(string_split(den, '|')), metric_id FROM c WHERE den <> '' UNION ALL SELECT 'governed_by', metric_id, unnest(CASE WHEN ok THEN ['sql_or_ddl_policy', 'authorized_dimension_scope_policy'] ELSE ['undefined_or_unsupported_metric_policy'] END) FROM c
 UNION ALL SELECT 'rolls_up_to', child, parent FROM ({PARENTS}) p WHERE parent <> '' UNION ALL SELECT 'binding:' || m, metric_id, replace(m, 'measure.amt_', 'tab_') FROM (SELECT metric_id, unnest(cov) AS m FROM c)""")
def _(t):
    edges, bindings = MF.edges_of(contract(t), t.sql(PARENTS), t.sql(MEASURES), t.sql(MODELS))
    return edges.union(bindings.select(F.concat(F.lit("binding:"), "dependency_node_id"), "metric_id", "physical_node_id"))


POLICY_EDGES = "SELECT concat('col_', CAST(s_suppkey AS STRING)) AS src, 'governed_by' AS edge_type, CASE WHEN s_suppkey % 3 = 0 THEN 'aggregate_only_policy' ELSE 'open' END AS dst FROM @supplier"


@query("ct_inexpressible", f"""SELECT 'granularity_hierarchy' AS family, 'dimension:' || child AS object, parent AS detail FROM ({PARENTS}) p WHERE parent <> ''
 UNION ALL SELECT 'formula_guard', 'metric:' || metric_id, formula FROM @part_metrics a WHERE answerable AND contains(formula, 'NULLIF')
 UNION ALL SELECT 'unsupported_metric_policy', 'metric:' || metric_id, 'refuse' FROM @part_metrics b WHERE NOT answerable
 UNION ALL SELECT 'metric_dimension_reachability', 'metric:' || metric_id, array_to_string(list_sort(list_filter({DIM_IDS}, lambda d: NOT list_contains(string_split(allowed_dimensions, '|'), d))), '|') FROM @part_metrics c WHERE answerable
 UNION ALL SELECT 'disclosure_policy', 'column:' || src, dst FROM ({POLICY_EDGES}) e WHERE dst = 'aggregate_only_policy'""")
def _(t):
    return MF.inexpressible(part_metrics(t), t.sql(PARENTS), t.sql(POLICY_EDGES), DIM_IDS)
