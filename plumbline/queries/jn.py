"""Logical joins."""

from pyspark.sql import functions as F

from plumbline.fixtures import values
from plumbline.functions import text as X
from plumbline.operators import joins as JN, metrics as M, scale
from plumbline.operators.dimensions import aliases as dimension_aliases
from plumbline.plans.governed import DIMENSIONS
from plumbline.queries import query
from plumbline.queries.ct import ALIASES, CAT, DEC, METRIC_V, NODES, part_metrics
from plumbline.queries.mx import FACT

LIST = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\|"), lambda d: d != "")


@query("jn_pred_gold", """SELECT p.mode, p.case_id, p.action, g.expected_action FROM @predictions p JOIN @gold g ON p.case_id = g.case_id""")
def _(t):
    p, g = t.predictions, t.gold
    assert JN.same_keys(p, g, "case_id").isEmpty()
    return p.join(g.select("case_id", "expected_action"), "case_id").select("mode", "case_id", "action", "expected_action")


@query("jn_catalog_lookup", f"""SELECT request_id, m.metric_id IS NOT NULL AS known, coalesce(m.answerable, false) AS answerable FROM (SELECT request_id, CASE WHEN request_id % 31 = 7 THEN 'ghost' ELSE g_metric END AS metric_id FROM @requests r0) r LEFT JOIN ({METRIC_V}) m USING (metric_id)""")
def _(t):
    r = t.requests.select("request_id", F.when(F.col("request_id") % 31 == 7, "ghost").otherwise(F.col("g_metric")).alias("metric_id"))
    m = CAT.metric_rows(t.spark).select("metric_id", F.lit(True).alias("k"), "answerable")
    j = r.join(m, "metric_id", "left")
    return j.select("request_id", F.coalesce("k", F.lit(False)).alias("known"), F.coalesce("answerable", F.lit(False)).alias("answerable"))


@query("jn_alias_theta", f"""SELECT DISTINCT request_id, dim FROM (SELECT request_id, trim(regexp_replace(lower(nl_query), '\\s+', ' ', 'g')) AS q FROM @requests r0) r
 JOIN ({ALIASES}) a ON CASE WHEN regexp_full_match(alias, '[a-z0-9_ ]+') THEN regexp_matches(q, '(^|[^a-z0-9_])' || alias || '([^a-z0-9_]|$)') ELSE contains(q, alias) END""")
def _(t):
    rows = [{"dim": d["dimension_id"], "alias": " ".join(a.lower().split())} for d in DIMENSIONS for a in dimension_aliases(d)]
    from pyspark.sql import types as T
    from plumbline.sources.catalog import rows_of

    aliases = rows_of(t.spark, rows, T.StructType([T.StructField("dim", T.StringType()), T.StructField("alias", T.StringType())])).distinct()
    texts = t.requests.select("request_id", X.normalize(F.col("nl_query")).alias("q"))
    return JN.alias_join(texts, "request_id", "q", aliases).select("request_id", "dim").distinct()


WANT = """SELECT l_orderkey, l_linenumber, concat('m_', CAST(l_partkey AS STRING)) AS metric_id, split_part('region|nation|brand|segment|month|quarter|priority', '|', CAST(1 + (l_orderkey + l_linenumber) % 7 AS INT)) AS dim FROM @lineitem"""
ALLOWED = "SELECT metric_id, unnest(string_split(allowed_dimensions, '|')) AS dim FROM @part_metrics pm WHERE allowed_dimensions <> ''"


@query("jn_metric_dim_allowed", f"""WITH a AS ({ALLOWED}) SELECT l_orderkey, l_linenumber, metric_id, dim FROM ({WANT}) w WHERE metric_id IN (SELECT metric_id FROM a) AND (metric_id, dim) NOT IN (SELECT metric_id, dim FROM a)""")
def _(t):
    allowed = t.part_metrics.select("metric_id", F.explode(LIST("allowed_dimensions")).alias("dim"))
    return JN.not_allowed(t.sql(WANT), allowed).select("l_orderkey", "l_linenumber", "metric_id", "dim")


@query("jn_unknown_members", """SELECT l_orderkey, l_linenumber, id FROM (SELECT l_orderkey, l_linenumber, l_partkey + CASE WHEN l_linenumber = 5 THEN 100000000 ELSE 0 END AS id FROM lineitem) w WHERE id NOT IN (SELECT p_partkey FROM part)""")
def _(t):
    ids = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_partkey") + F.when(F.col("l_linenumber") == 5, 100000000).otherwise(0)).alias("id"))
    return JN.unknown_members(ids, t.part.select(F.col("p_partkey").alias("id")), "id").select("l_orderkey", "l_linenumber", "id")


TOPK = """SELECT request_id, concat(g_metric, '|', d1) AS found, g_metric, request_id % 4 AS r FROM @requests r0"""


@query("jn_candidate_semi", f"""SELECT request_id, g_metric FROM ({TOPK}) k WHERE r < 2""")
def _(t):
    k = t.sql(TOPK)
    found = k.select("request_id", F.explode(LIST("found")).alias("m")).withColumn("g_metric", F.when(F.col("request_id") % 4 < 2, F.col("m")))
    return k.select("request_id", "g_metric").join(found, ["request_id", "g_metric"], "left_semi")


PARENTS = """SELECT concat('c', CAST(c_custkey AS STRING)) AS child, concat('n', CAST(c_nationkey AS STRING)) AS parent FROM @customer
 UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)) FROM @nation
 UNION ALL SELECT concat('r', CAST(r_regionkey AS STRING)), CASE WHEN r_regionkey = 0 THEN 'r1' WHEN r_regionkey = 1 THEN 'r0' ELSE 'world' END FROM @region UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), '' FROM @supplier"""
CLOSED = f"""WITH RECURSIVE p AS ({PARENTS}), c(child, ancestor, depth, path) AS (SELECT child, parent, 1, [parent] FROM p WHERE parent <> '' UNION ALL SELECT c.child, p.parent, depth + 1, list_append(path, p.parent) FROM c JOIN p ON p.child = c.ancestor WHERE p.parent <> '' AND NOT list_contains(path, p.parent))"""


@query("jn_hierarchy_closure", CLOSED + " SELECT child, ancestor, depth FROM c")
def _(t):
    return JN.closure(t.sql(PARENTS))


REQ = """SELECT o_orderkey, concat('c', CAST(o_custkey AS STRING)) AS a, concat('n', CAST(c_nationkey AS STRING)) AS b, CASE WHEN o_orderkey % 2 = 0 THEN 'r3' ELSE 'world' END AS c FROM @orders JOIN @customer ON o_custkey = c_custkey WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 'n7', concat('n', CAST(o_orderkey % 25 AS STRING)), 's1' FROM @orders WHERE o_orderkey % 5 = 0"""


@query("jn_finest_self", CLOSED.replace("WITH RECURSIVE", f"WITH RECURSIVE q AS (SELECT DISTINCT o_orderkey, unnest([a, b, c]) AS dim FROM ({REQ}) r),") + """ SELECT o_orderkey, dim FROM q WHERE NOT EXISTS (SELECT 1 FROM q o JOIN c ON o.dim = c.child WHERE o.o_orderkey = q.o_orderkey AND c.ancestor = q.dim)""")
def _(t):
    req = t.sql(REQ).select("o_orderkey", F.explode(F.array("a", "b", "c")).alias("dim")).distinct()
    return JN.finest(req, JN.closure(t.sql(PARENTS)), "o_orderkey")


@query("jn_coverage_binding", f"""WITH n AS ({NODES}), a AS (SELECT DISTINCT semantic_node_id AS id FROM @part_coverage c0) SELECT DISTINCT n.metric_id, node, coalesce(physical_node_id, '') AS physical_node_id, CASE WHEN b.metric_id IS NULL THEN 'missing_binding' ELSE 'missing_physical_asset' END AS problem
 FROM n LEFT JOIN @part_bindings b ON b.metric_id = n.metric_id AND dependency_node_id = node WHERE b.metric_id IS NULL OR physical_node_id IS NULL OR physical_node_id NOT IN (SELECT id FROM a)""")
def _(t):
    nodes = part_metrics(t).select("metric_id", F.explode("coverage_nodes").alias("node"))
    return JN.coverage_gaps(nodes, t.part_bindings, t.part_coverage)


@query("jn_dangling_refs", """WITH a AS (SELECT DISTINCT semantic_node_id AS id FROM @part_coverage c0) SELECT 'dangling' AS problem, binding_id AS id FROM @part_bindings b WHERE coalesce(physical_node_id, '') NOT IN (SELECT id FROM a)
 UNION ALL SELECT DISTINCT 'malformed', domain_id || '/' || semantic_node_id FROM @part_coverage c1 WHERE NOT regexp_matches(semantic_node_id, '^phys_')""")
def _(t):
    assets = t.part_coverage.select(F.col("semantic_node_id").alias("physical_node_id")).distinct()
    b = t.part_bindings.withColumn("physical_node_id", F.coalesce("physical_node_id", F.lit("")))
    dangling = JN.unknown_members(b, assets, "physical_node_id").select(F.lit("dangling").alias("problem"), F.col("binding_id").alias("id"))
    bad = t.part_coverage.filter(~F.col("semantic_node_id").rlike("^phys_")).select(F.lit("malformed").alias("problem"), F.concat_ws("/", "domain_id", "semantic_node_id").alias("id")).distinct()
    return dangling.union(bad)


@query("jn_edge_contract_check", """WITH e AS (SELECT metric_id, list_sort(list_distinct(list(src) FILTER (edge_type = 'numerator_of'))) AS n, list_sort(list_distinct(list(src) FILTER (edge_type = 'denominator_of'))) AS d FROM @part_edges e0 WHERE metric_id IS NOT NULL GROUP BY 1),
 b AS (SELECT metric_id, list(DISTINCT dependency_node_id) AS b FROM @part_bindings b0 GROUP BY 1)
 SELECT m.metric_id, NOT scoped_ratio OR (numerator_nodes <> '' AND denominator_nodes <> '' AND list_sort(string_split(numerator_nodes, '|')) = coalesce(n, []) AND list_sort(string_split(denominator_nodes, '|')) = coalesce(d, [])) AS edges_ok,
 coverage_nodes = '' OR list_has_all(coalesce(b, []), string_split(coverage_nodes, '|')) AS bindings_ok FROM @part_metrics m LEFT JOIN e USING (metric_id) LEFT JOIN b USING (metric_id)""")
def _(t):
    return JN.edge_contract(part_metrics(t), t.part_edges, t.part_bindings)


ENTITIES = """SELECT concat('mod', CAST(p_partkey AS STRING)) AS model, concat('e', CAST(p_partkey AS STRING)) AS entity, CASE WHEN p_partkey % 3 = 0 THEN 'primary' WHEN p_partkey % 3 = 1 THEN 'unique' ELSE 'natural' END AS type FROM @part
 UNION ALL SELECT concat('mod', CAST(p_partkey AS STRING)), concat('e', CAST(p_size AS STRING)), 'foreign' FROM @part"""


@query("jn_entity_reach", f"""WITH e AS ({ENTITIES}) SELECT DISTINCT a.model, b.model AS reachable FROM e a JOIN e b ON a.entity = b.entity AND (b.type IN ('primary', 'unique') OR a.model = b.model)""")
def _(t):
    return JN.entity_reach(t.sql(ENTITIES))


@query("jn_star_metric", f"""SELECT r_name, p_brand, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(sum(l_quantity * is_return) / sum(l_quantity), 6) AS return_share FROM {FACT} f GROUP BY ALL""")
def _(t):
    f = M.star(t.lineitem, t.orders, t.customer, t.nation, t.region, t.part)
    return f.groupBy("r_name", "p_brand").agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 4).alias("revenue"),
                                              F.round(M.ratio(F.sum(F.expr("l_quantity * is_return")), F.sum("l_quantity")), 6).alias("return_share"))


@query("jn_mode_pair", """SELECT a.case_id, a.pred_metric_id AS "left", b.pred_metric_id AS "right" FROM @predictions a JOIN @predictions b ON a.case_id = b.case_id WHERE a.mode = 'guarded' AND b.mode = 'compiled'""")
def _(t):
    return JN.mode_pair(t.predictions, "case_id", "mode", "guarded", "compiled", "pred_metric_id")


TCAT = """SELECT p_partkey AS pos, concat('Proj.', p_type, '.tbl_', CAST(p_size AS STRING)) AS tbl, concat('col_', CAST(p_partkey % 97 AS STRING)) AS col FROM @part"""
WISH = """SELECT o_orderkey, concat('COL_', CAST(o_orderkey % 101 AS STRING)) AS col, CASE o_orderkey % 3 WHEN 0 THEN concat('tbl_', CAST(o_orderkey % 60 AS STRING)) WHEN 1 THEN concat('economy.TBL_', CAST(o_orderkey % 400 AS STRING)) ELSE 'nowhere' END AS tbl FROM @orders"""
WIN = "list_contains([lower(c.tbl), regexp_replace(lower(c.tbl), '^proj.', ''), split_part(lower(c.tbl), '.', 3), 'proj.' || split_part(lower(c.tbl), '.', 2), 'proj', split_part(lower(c.tbl), '.', 2)], lower(w.tbl))"
MASK = lambda e: f"regexp_replace(regexp_replace({e}, '[0-9]', '*', 'g'), '\\*+', '*', 'g')"
WIN_M = f"list_contains([{MASK('lower(c.tbl)')}, regexp_replace({MASK('lower(c.tbl)')}, '^proj.', ''), split_part({MASK('lower(c.tbl)')}, '.', 3)], {MASK('lower(w.tbl)')})"


@query("jn_tiered_table_match", f"""WITH c AS ({TCAT}), w AS ({WISH}), e AS (SELECT o_orderkey, c.tbl, c.col, pos, 1 AS tier FROM w JOIN c ON lower(c.col) = lower(w.col) AND {WIN}),
 m AS (SELECT o_orderkey, c.tbl, c.col, pos, 2 AS tier FROM w JOIN c ON lower(c.col) = lower(w.col) AND {WIN_M} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM e)),
 l AS (SELECT o_orderkey, tbl, col, pos, 3 AS tier FROM (SELECT o_orderkey, c.tbl, c.col, pos, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos) AS rn FROM w JOIN c ON lower(c.col) = lower(w.col) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM e) AND o_orderkey NOT IN (SELECT o_orderkey FROM m)) WHERE rn <= 5)
 SELECT o_orderkey, tbl, col, pos, tier FROM e UNION ALL SELECT * FROM m UNION ALL SELECT * FROM l""")
def _(t):
    return JN.tiered_match(t.sql(WISH), "o_orderkey", t.sql(TCAT), "pos")


@query("jn_suffix_window_match", f"""WITH c AS (SELECT DISTINCT tbl FROM ({TCAT}) x), w AS (SELECT DISTINCT tbl FROM ({WISH}) y UNION SELECT 'proj.' || lower(p_type) FROM part) SELECT c.tbl, w.tbl AS target FROM c JOIN w ON {WIN}""")
def _(t):
    targets = t.sql(WISH).select(F.col("tbl").alias("target")).union(t.part.select(F.concat(F.lit("proj."), F.lower("p_type")))).distinct()
    return JN.window_match(t.sql(TCAT).select("tbl").distinct(), "tbl", targets, "target")


TABLES_OF = """SELECT l_partkey AS pos, concat('t_', CAST(l_partkey AS STRING), CASE WHEN l_partkey % 3 = 0 THEN '_x' ELSE '' END) AS tbl, concat(l_returnflag, '_', l_linestatus) AS col FROM @lineitem"""


@query("jn_similar_tables", f"""WITH t AS (SELECT tbl, min(pos) AS pos, array_to_string(list_sort(list_distinct(list(col))), ',') AS cols FROM ({TABLES_OF}) x GROUP BY 1)
 SELECT tbl, first_value(tbl) OVER w AS family, count(*) OVER (PARTITION BY regexp_replace(tbl, '[0-9]', '', 'g'), cols) AS members FROM t WINDOW w AS (PARTITION BY regexp_replace(tbl, '[0-9]', '', 'g'), cols ORDER BY pos)""")
def _(t):
    return JN.similar_tables(t.sql(TABLES_OF), "pos")


SCHEMA_COLS = """SELECT concat('db', CAST(s_nationkey AS STRING)) AS db, concat('t', CAST(s_suppkey AS STRING)) AS tbl, s_suppkey AS seq, 'id' AS col, 'int' AS type, true AS is_pk, (s_suppkey % 5 <> 0) AS sole_pk FROM @supplier
 UNION ALL SELECT concat('db', CAST(s_nationkey AS STRING)), concat('t', CAST(s_suppkey AS STRING)), s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN concat('parent_t', CAST(s_suppkey - 1 AS STRING), '_id') ELSE concat('t', CAST(s_suppkey % 20 AS STRING), '_id') END, CASE WHEN s_suppkey % 7 = 0 THEN 'text' ELSE 'int' END, false, (s_suppkey % 5 <> 0) FROM @supplier
 UNION ALL SELECT concat('db', CAST(s_nationkey AS STRING)), concat('t', CAST(s_suppkey AS STRING)), s_suppkey, 'region_code', 'text', (s_suppkey % 5 = 0), (s_suppkey % 5 <> 0) FROM @supplier"""
LINKS = """SELECT concat('db', CAST(s_nationkey AS STRING)) AS db, concat('t', CAST(s_suppkey % 20 AS STRING)) AS pk_tbl, concat('t', CAST(s_suppkey AS STRING)) AS fk_tbl, concat('t', CAST(s_suppkey % 20 AS STRING), '_id') AS fk_col FROM @supplier WHERE s_suppkey % 2 = 0"""


@query("jn_relationship_discovery", f"""WITH c AS (SELECT *, CASE WHEN lower(col) = 'id' THEN tbl || '_id' ELSE lower(col) END AS label FROM ({SCHEMA_COLS}) x WHERE length(col) > 1),
 p AS (SELECT i.db, i.tbl AS it, i.col AS ic, i.is_pk AS ip, j.tbl AS jt, j.col AS jc FROM c i JOIN c j ON i.db = j.db AND i.seq < j.seq AND i.type = j.type AND (contains(i.label, j.label) OR contains(j.label, i.label))
   WHERE NOT (i.sole_pk AND i.is_pk AND j.sole_pk AND j.is_pk) AND (i.is_pk OR j.is_pk)),
 o AS (SELECT DISTINCT db, CASE WHEN ip THEN it ELSE jt END AS pk_tbl, CASE WHEN ip THEN ic ELSE jc END AS pk_col, CASE WHEN ip THEN jt ELSE it END AS fk_tbl, CASE WHEN ip THEN jc ELSE ic END AS fk_col FROM p)
 SELECT o.* FROM o LEFT JOIN ({LINKS}) l USING (db, pk_tbl, fk_tbl, fk_col) WHERE l.db IS NULL""")
def _(t):
    return JN.relationships(t.sql(SCHEMA_COLS), t.sql(LINKS))


@query("jn_query_pairs", """SELECT l_suppkey, l_linestatus, l_orderkey * 10 + l_linenumber AS pos, lead(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_suppkey, l_linestatus ORDER BY l_orderkey * 10 + l_linenumber) AS next, NULL::BIGINT AS pairs FROM (SELECT DISTINCT l_suppkey, l_linestatus, l_orderkey, l_linenumber FROM lineitem) d QUALIFY next IS NOT NULL
 UNION ALL SELECT l_suppkey, l_linestatus, NULL, NULL, (count(*) * (count(*) - 1) // 2)::BIGINT FROM (SELECT DISTINCT l_suppkey, l_linestatus, l_orderkey, l_linenumber FROM lineitem) d GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    q = t.lineitem.select("l_suppkey", "l_linestatus", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")).distinct()
    keys = ["l_suppkey", "l_linestatus"]
    links = JN.next_in_group(q, keys, "pos", scale.key_buckets("pos", 100_000, 1 << 30))
    return links.unionByName(JN.pair_counts(q, keys), allowMissingColumns=True)


ERRORS = """SELECT c_nationkey AS db, src AS source, CAST(SUM(CASE WHEN (c_custkey + length(src)) % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM (SELECT *, EXPLODE['spider', 'dev', 'train'] AS src FROM @customer) x WHERE NOT (src = 'dev' AND c_nationkey % 4 = 0) GROUP BY c_nationkey, src"""


@query("jn_source_selection", f"""SELECT db, source, errors FROM (SELECT *, row_number() OVER (PARTITION BY db ORDER BY errors, CASE source WHEN 'spider' THEN 0 WHEN 'dev' THEN 1 ELSE 2 END) AS rn FROM ({ERRORS}) e) z WHERE rn = 1""")
def _(t):
    return JN.source_selection(t.sql(ERRORS), {"spider": 0, "dev": 1, "train": 2})


LEAVES = """SELECT p_brand AS tbl, concat(p_type, CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('.f', CAST(p_size AS STRING)) END) AS leaf FROM @part"""
PICKED = "SELECT DISTINCT p_brand AS tbl, CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE p_type END AS col FROM @part"


@query("jn_nested_expand", f"""SELECT DISTINCT s.tbl, s.col, l.leaf FROM ({PICKED}) s JOIN ({LEAVES}) l ON s.tbl = l.tbl AND lower(split_part(l.leaf, '.', 1)) = lower(s.col) WHERE contains(l.leaf, '.') OR l.leaf = s.col""")
def _(t):
    return JN.nested_expand(t.sql(PICKED), t.sql(LEAVES))
