"""Contract checks and decisions."""

from pyspark.sql import functions as F

from plumbline.fixtures import values
from plumbline.functions import text as X
from plumbline.operators import contract as C, filters as P
from plumbline.plans.governed import DIMENSIONS, METRICS, POLICIES, PROFILE, catalog
from plumbline.queries import query
from plumbline.sources.catalog import Catalog, rows_of, METRIC_SCHEMA

CAT = catalog()
J = lambda c, sep="|": F.array_join(c, sep)
LIST = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\|"), lambda d: d != "")

# --- the same rules in SQL ----------------------------------------------------------------------

ALIASES = values([(d["dimension_id"], d["grain_rank"], " ".join(a.lower().split())) for d in DIMENSIONS
                  for a in dict.fromkeys([d["dimension_id"], d["name"], *d["aliases"]])], ["dim", "rk", "alias"])
CLOSURE = values([(d, a) for d, up in CAT.closure().items() for a in up], ["dim", "anc"])
METRIC_V = values([(m["metric_id"], "|".join(m["allowed_dimensions"]), str(m["answerable"]).lower(), str(m["temporal_anchor_required"]).lower()) for m in METRICS],
                  ["metric_id", "allowed", "answerable", "temporal"])
TRIGGERS = values([("sql_or_ddl", t, t) for t in ["drop ", "delete ", "insert ", "update ", "truncate "]] + [("sql_or_ddl", "select ", "select")] +
                  [("sensitive", t, t) for t in ["phone list", "email", "phone", "personal contact", "customer identifier"]] +
                  [("off_domain", "weather", "weather"), ("off_domain", "tomorrow", "tomorrow"), ("row_level", "contains", "raw rows")], ["pid", "trig", "needle"])
RAW = "SELECT request_id, nl_query, CASE WHEN request_id % 31 = 7 THEN 'ghost' ELSE g_metric END AS metric_id FROM @requests r0"


def cut(m, n):
    return f"WHEN contains(q, '{m}') THEN nullif(substr(q, strpos(q, '{m}') + {n}), '')"


MARK = " ".join(cut(m, len(m)) for m in C.MARKERS)


def sql_decisions(raw=RAW, allowed_drop=""):
    return f"""r AS (SELECT *, trim(regexp_replace(lower(nl_query), '\\s+', ' ', 'g')) AS q FROM ({raw}) r1),
 s AS (SELECT *, coalesce(coalesce(CASE {MARK} END, CASE {cut('按', 1)} END, CASE WHEN contains(q, 'breakdown for') THEN nullif(substr(q, 1, strpos(q, 'breakdown for') - 1), '') END,
   CASE WHEN regexp_matches(q, 'monthly|quarterly|valid time anchor|with the valid time') THEN q END)
   || CASE WHEN contains(q, 'monthly') THEN ' monthly month' ELSE '' END || CASE WHEN contains(q, 'quarterly') THEN ' quarterly quarter' ELSE '' END, '') AS scope FROM r),
 dm AS (SELECT DISTINCT request_id, dim, rk FROM s JOIN ({ALIASES}) a ON CASE WHEN regexp_full_match(alias, '[a-z0-9_ ]+') THEN regexp_matches(scope, '(^|[^a-z0-9_])' || alias || '([^a-z0-9_]|$)') ELSE contains(scope, alias) END),
 fin AS (SELECT dm.* FROM dm WHERE NOT EXISTS (SELECT 1 FROM dm o JOIN ({CLOSURE}) c ON o.dim = c.dim WHERE o.request_id = dm.request_id AND c.anc = dm.dim)),
 da AS (SELECT request_id, string_agg(dim, '|' ORDER BY rk, dim) AS requested FROM dm GROUP BY 1),
 fa AS (SELECT request_id, string_agg(dim, '|' ORDER BY rk, dim) AS resolved, bool_or(dim = 'part_type') AS uncovered FROM fin GROUP BY 1),
 mv AS (SELECT * FROM ({METRIC_V}) v0),
 ba AS (SELECT fin.request_id, string_agg(dim, '|' ORDER BY dim) AS barred FROM fin JOIN r USING (request_id) JOIN mv USING (metric_id)
   WHERE allowed <> '' AND NOT list_contains(string_split(allowed, '|'), dim) GROUP BY 1),
 hit AS (SELECT DISTINCT request_id, pid, trig FROM r JOIN ({TRIGGERS}) t ON contains(q, needle)
   UNION SELECT request_id, 'sensitive', 'ambiguous_query' FROM r WHERE q = 'show me the numbers'
   UNION SELECT request_id, 'no_governed_metric', 'empty_metric_candidate' FROM r WHERE metric_id NOT IN (SELECT metric_id FROM mv)
   UNION SELECT request_id, 'unsupported_metric', metric_id FROM r JOIN mv USING (metric_id) WHERE NOT answerable),
 ph AS (SELECT request_id, string_agg(pid || ':' || trig, '|' ORDER BY pid, trig) AS hits FROM hit GROUP BY 1),
 tm AS (SELECT request_id, CASE WHEN regexp_matches(q, '(^|[^a-z0-9_])last year([^a-z0-9_]|$)') OR contains(q, '去年') THEN 'last_year'
   WHEN regexp_matches(q, '(^|[^a-z0-9_])199[5-9]([^a-z0-9_]|$)') THEN regexp_extract(q, '(199[5-9])', 1)
   WHEN regexp_matches(q, '\\b20[0-9]{{2}}\\b') THEN regexp_extract(q, '\\b(20[0-9]{{2}})\\b', 1) ELSE '2000' END AS anchor FROM r),
 chk AS (SELECT r.request_id, r.metric_id, coalesce(requested, '') AS requested, coalesce(resolved, '') AS resolved, coalesce(barred, '') AS barred, coalesce(hits, '') AS hits, anchor,
   mv.metric_id IS NOT NULL AS field_ok, barred IS NULL AS grain_ok, NOT coalesce(uncovered, false) AS coverage_ok, (anchor IN ('1995','1996','1997','1998','1999','2000','2001','last_year')) AS time_ok, hits IS NULL AS policy_ok, coalesce(temporal, false) AS temporal
   FROM r LEFT JOIN da USING (request_id) LEFT JOIN fa USING (request_id) LEFT JOIN ba USING (request_id) LEFT JOIN ph USING (request_id) LEFT JOIN tm USING (request_id) LEFT JOIN mv ON r.metric_id = mv.metric_id)"""


def sql_failed(off=()):
    flags = [f"CASE WHEN NOT {f}_ok THEN '{f}' END" for f in ("field", "grain", "coverage", "time", "policy") if f not in off]
    return f"concat_ws(',', {', '.join(flags)})"


DEC = "WITH " + sql_decisions()


def decided(t, raw=RAW, **kw):
    return C.compile_requests(t.spread(raw), C.contract_of(t.spark, CAT), CAT, **kw)


def requested(t):
    return C.with_scope(t.spread(RAW)).select("request_id", "metric_id", "_q", C.detect_dimensions(F.col("_scope"), CAT).alias("dims"))


@query("ct_detect_dimensions", DEC + " SELECT request_id, requested AS dims FROM chk")
def _(t):
    return requested(t).select("request_id", J("dims").alias("dims"))


@query("ct_finest_grain", DEC + " SELECT request_id, requested, resolved FROM chk")
def _(t):
    return requested(t).select("request_id", J("dims").alias("requested"), J(C.finest(F.col("dims"), CAT)).alias("resolved"))


@query("ct_detect_time", DEC + " SELECT request_id, anchor FROM tm")
def _(t):
    return requested(t).select("request_id", C.detect_time(F.col("_q"), PROFILE).alias("anchor"))


UNKNOWN = "SELECT request_id, nl_query, CASE WHEN request_id % 31 = 7 THEN 'ghost' ELSE g_metric END AS metric_id, concat(d1, CASE WHEN request_id % 5 = 0 THEN '|planet' ELSE '' END) AS dims FROM @requests r0"


def checks(t, raw, name, *cols):
    d = t.spread(raw)
    if "dims" in d.columns:
        d = d.withColumn("requested", LIST("dims"))
    c = C.compile_requests(d, C.contract_of(t.spark, CAT), CAT).select("request_id", F.col(f"decision.trace.checks.{name}").alias("k"))
    return c.select("request_id", F.col("k.active").alias("active"), F.col("k.passed").alias("passed"), *cols)


@query("ct_check_field", f"SELECT request_id, true AS active, metric_id <> 'ghost' AND request_id % 5 <> 0 AS passed, CASE WHEN request_id % 5 = 0 THEN 'planet' ELSE '' END AS unknown FROM ({UNKNOWN}) u")
def _(t):
    return checks(t, UNKNOWN, "field", J("k.unknown_dimensions").alias("unknown"))


DEP = """WITH e AS (SELECT dst AS metric_id, edge_type, list_sort(list_distinct(list(src))) AS srcs FROM @part_edges e0 WHERE coalesce(metric_id, dst) = dst AND edge_type IN ('numerator_of', 'denominator_of') GROUP BY ALL),
 m AS (SELECT m.*, coalesce(en.srcs, []) AS en, coalesce(ed.srcs, []) AS ed, list_filter(string_split(numerator_nodes, '|'), lambda x: x <> '') AS wn, list_filter(string_split(denominator_nodes, '|'), lambda x: x <> '') AS wd,
   scoped_ratio OR metric_type = 'ratio' OR contains(formula, '/') OR numerator <> '' OR denominator <> '' AS ratio FROM @part_metrics m LEFT JOIN e en ON en.metric_id = m.metric_id AND en.edge_type = 'numerator_of' LEFT JOIN e ed ON ed.metric_id = m.metric_id AND ed.edge_type = 'denominator_of'),
 f AS (SELECT *, CASE WHEN numerator <> '' THEN ['top'] WHEN formula LIKE '%/ NULLIF%' THEN ['num_x'] WHEN formula LIKE '%/ 1' THEN ['sales'] ELSE [] END AS tn,
   CASE WHEN denominator <> '' THEN ['bottom'] WHEN formula LIKE '%/ NULLIF%' THEN ['den_x'] ELSE [] END AS td FROM m),
 g AS (SELECT *, CASE WHEN NOT ratio THEN [] WHEN len(wn) > 0 THEN list_filter(en, lambda x: list_contains(wn, x)) WHEN len(tn) > 0 THEN tn ELSE en END AS num,
   CASE WHEN NOT ratio THEN [] WHEN len(wn) > 0 THEN list_filter(ed, lambda x: list_contains(wd, x)) WHEN len(td) > 0 THEN td ELSE ed END AS den,
   CASE WHEN NOT ratio THEN 'not_required' WHEN len(wn) = 0 AND len(tn) > 0 AND len(td) > 0 THEN 'metric_formula' ELSE 'metric_specific_typed_graph_edges' END AS route FROM f)"""


def part_metrics(t):
    m = t.part_metrics
    for c in ("numerator_nodes", "denominator_nodes", "coverage_nodes", "allowed_dimensions"):
        m = m.withColumn(c, LIST(c))
    return m.withColumn("scoped_ratio_kind", F.lit("none")).withColumn("temporal_anchor_required", F.col("p_partkey") % 4 == 0)


@query("ct_dependency_evidence", DEP + " SELECT metric_id, ratio AS ratio_like, array_to_string(list_sort(num), '|') AS num, array_to_string(list_sort(den), '|') AS den, route AS route_source FROM g")
def _(t):
    e = C.dependency_evidence(part_metrics(t), t.part_edges)
    return e.select("metric_id", "ratio_like", J("found_numerator").alias("num"), J("found_denominator").alias("den"), "route_source")


@query("ct_check_caliber", DEP + """ SELECT metric_id, NOT ratio OR (len(num) > 0 AND len(den) > 0 AND (len(wn) = 0 OR (list_has_all(num, wn) AND list_has_all(den, wd)))) AS passed FROM g""")
def _(t):
    return C.dependency_evidence(part_metrics(t), t.part_edges).select("metric_id", C.caliber_passed().alias("passed"))


@query("ct_check_grain", DEC + " SELECT request_id, true AS active, grain_ok AS passed, requested, resolved, barred FROM chk")
def _(t):
    return checks(t, RAW, "grain", J("k.requested").alias("requested"), J("k.resolved_finest").alias("resolved"), J("k.disallowed").alias("barred"))


M_FIELDS = {m["metric_id"]: {"revenue": "l_discount|l_extendedprice", "units": "l_quantity", "order_count": "o_orderkey", "customer_count": "o_custkey",
            "average_order_value": "l_discount|l_extendedprice|o_orderkey", "average_unit_price": "l_extendedprice|l_quantity", "return_share": "is_return|l_quantity",
            "discount_amount": "l_discount|l_extendedprice", "profit_margin": ""}[m["metric_id"]] for m in METRICS}
D_FIELDS = {"region": "r_name", "nation": "n_name", "customer": "c_name", "year": "o_orderdate", "quarter": "o_orderdate", "month": "o_orderdate", "brand": "p_brand",
            "part_type": "p_type", "segment": "c_mktsegment", "priority": "o_orderpriority"}


@query("ct_required_fields", DEC + f""", need AS (SELECT request_id, unnest(string_split(f, '|')) AS c FROM r JOIN ({values(list(M_FIELDS.items()), ['metric_id', 'f'])}) v USING (metric_id) WHERE f <> ''
 UNION SELECT request_id, f FROM fin JOIN ({values(list(D_FIELDS.items()), ['dim', 'f'])}) v USING (dim))
 SELECT r.request_id, coalesce(string_agg(c, '|' ORDER BY c), '') AS required FROM r LEFT JOIN need USING (request_id) GROUP BY 1""")
def _(t):
    return checks(t, RAW, "coverage", J("k.required").alias("required")).select("request_id", "required")


@query("ct_check_coverage_schema", DEC + """ SELECT request_id, coverage_ok AND NOT (request_id % 10 = 3 AND metric_id = 'units') AS passed,
 concat_ws('|', CASE WHEN request_id % 10 = 3 AND metric_id = 'units' THEN 'l_quantity' END, CASE WHEN NOT coverage_ok THEN 'p_type' END) AS missing FROM chk""")
def _(t):
    d = t.spread(RAW).withColumn("coverage_remove", F.when((F.col("request_id") % 10 == 3) & (F.col("metric_id") == "units"), F.array(F.lit("l_quantity"))))
    c = C.compile_requests(d, C.contract_of(t.spark, CAT), CAT).select("request_id", F.col("decision.trace.checks.coverage").alias("k"))
    return c.select("request_id", "k.passed", J("k.missing").alias("missing"))


NODES = "SELECT metric_id, domain_id, coverage_required, unnest(CASE WHEN coverage_nodes = '' THEN [] ELSE string_split(coverage_nodes, '|') END) AS node FROM @part_metrics n0"


@query("ct_check_coverage_binding", f"""WITH n AS ({NODES}), b AS (SELECT b.*, semantic_node_id IS NULL AS lost FROM @part_bindings b LEFT JOIN (SELECT DISTINCT semantic_node_id FROM @part_coverage c0) c ON physical_node_id = semantic_node_id),
 x AS (SELECT n.metric_id, node, max(CASE WHEN b.metric_id IS NULL THEN node END) AS unbound, max(CASE WHEN lost THEN coalesce(physical_node_id, '') END) AS unreal FROM n LEFT JOIN b ON b.metric_id = n.metric_id AND dependency_node_id = node GROUP BY 1, 2),
 y AS (SELECT metric_id, coalesce(string_agg(DISTINCT unbound, '|' ORDER BY unbound), '') AS missing_bindings, coalesce(string_agg(DISTINCT unreal, '|' ORDER BY unreal), '') AS missing_assets, count(unbound) + count(unreal) AS bad FROM x GROUP BY 1)
 SELECT m.metric_id, coverage_required OR coverage_nodes <> '' AS active, NOT (coverage_required OR coverage_nodes <> '') OR (coverage_nodes <> '' AND coalesce(bad, 0) = 0) AS passed,
 coalesce(missing_bindings, '') AS missing_bindings, coalesce(missing_assets, '') AS missing_assets FROM @part_metrics m LEFT JOIN y USING (metric_id)""")
def _(t):
    c = C.coverage_binding(part_metrics(t), t.part_bindings, t.part_coverage)
    return c.select("metric_id", "active", "passed", J("missing_bindings").alias("missing_bindings"), J("missing_physical_assets").alias("missing_assets"))


@query("ct_check_coverage_domain", f"""WITH n AS ({NODES}), x AS (SELECT n.* FROM n LEFT JOIN @part_coverage c ON c.domain_id = n.domain_id AND semantic_node_id = node WHERE c.domain_id IS NULL),
 y AS (SELECT metric_id, string_agg(DISTINCT node, '|' ORDER BY node) AS missing FROM x GROUP BY 1)
 SELECT metric_id, coverage_nodes <> '' AS active, missing IS NULL AS passed, coalesce(missing, '') AS missing FROM @part_metrics m LEFT JOIN y USING (metric_id)""")
def _(t):
    return C.coverage_domain(part_metrics(t), t.part_coverage).select("metric_id", "active", "passed", J("missing").alias("missing"))


@query("ct_check_time", DEC + " SELECT request_id, true AS active, time_ok AS passed, temporal AS required, anchor AS detected FROM chk")
def _(t):
    return checks(t, RAW, "time", F.col("k.required").alias("required"), F.col("k.detected").alias("detected"))


@query("ct_policy_hits", DEC + " SELECT request_id, pid AS policy_id, trig FROM hit")
def _(t):
    h = decided(t).select("request_id", F.explode("decision.trace.checks.policy.hits").alias("h"))
    return h.select("request_id", "h.policy_id", F.col("h.trigger").alias("trig"))


def outcome(d, *more):
    cert = "decision.trace.certificate"
    return d.select("request_id", F.col("decision.action").alias("action"), F.col("decision.pred_metric_id").alias("pred_metric_id"), J("decision.pred_dimensions").alias("dims"),
                    F.col("decision.reason").alias("reason"), F.coalesce(J(f"{cert}.failed_constraints", ","), F.lit("")).alias("failed"),
                    F.coalesce(f"{cert}.repairable", F.lit(False)).alias("repairable"), *more)


def sql_outcome(failed):
    return f""" SELECT request_id, CASE WHEN f = '' THEN 'answer' ELSE 'refuse' END AS action, CASE WHEN f = '' THEN metric_id ELSE '' END AS pred_metric_id, CASE WHEN f = '' THEN resolved ELSE '' END AS dims,
 CASE WHEN f = '' THEN 'witness_satisfied' ELSE 'constraint_failure:' || split_part(f, ',', 1) END AS reason, f AS failed, f = 'grain' AS repairable FROM (SELECT *, {failed} AS f FROM chk) z"""


@query("ct_compile", DEC + sql_outcome(sql_failed()))
def _(t):
    return outcome(decided(t))


@query("ct_ablation", DEC + sql_outcome(sql_failed(("grain", "policy"))))
def _(t):
    return outcome(decided(t, disabled=("grain", "policy")))


CAND = """SELECT request_id * 10 + rank AS request_id, request_id AS case_key, rank, nl_query, CASE rank WHEN 1 THEN CASE WHEN request_id % 3 = 0 THEN 'profit_margin' ELSE g_metric END WHEN 2 THEN g_metric ELSE 'units' END AS metric_id
 FROM (SELECT *, EXPLODE[1, 2, 3] AS rank FROM @requests r0) r9"""


@query("ct_compile_candidates", "WITH " + sql_decisions(CAND) + f""" SELECT case_key, metric_id, f = '' AS passed, CAST(rank AS BIGINT) AS rank FROM (SELECT case_key, chk.metric_id, rank, {sql_failed()} AS f,
 row_number() OVER (PARTITION BY case_key ORDER BY {sql_failed()} <> '', rank) AS rn FROM chk JOIN (SELECT request_id, case_key, rank FROM r) k USING (request_id)) z WHERE rn = 1""")
def _(t):
    b = C.compile_candidates(t.spread(CAND), C.contract_of(t.spark, CAT), CAT, "case_key")
    return b.select("case_key", "metric_id", (F.col("decision.action") == "answer").alias("passed"), F.col("rank").cast("bigint").alias("rank"))


@query("ct_metadata_override", """SELECT metric_id, CASE WHEN p_partkey % 4 = 0 THEN 'SUM(x) / 1' ELSE formula END AS formula, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 8 = 0 THEN false ELSE answerable END AS answerable,
 CASE WHEN p_partkey % 4 = 0 THEN false ELSE NOT (scoped_ratio OR metric_type = 'ratio' OR contains(formula, '/') OR numerator <> '' OR denominator <> '') END AS plain FROM @part_metrics m""")
def _(t):
    m = part_metrics(t)
    patch = t.part.filter("p_partkey % 4 = 0").select(F.concat(F.lit("m_"), "p_partkey").alias("metric_id"), F.lit("SUM(x) / 1").alias("formula"),
                                                      F.when(F.col("p_partkey") % 8 == 0, F.lit(False)).alias("answerable"))
    p = C.dependency_evidence(C.patch_metrics(m, patch), t.part_edges)
    return p.select("metric_id", "formula", "answerable", (~F.col("ratio_like")).alias("plain"))


# One change of the contract or the request per family; the last is left as it was.
MUTATIONS = ["field", "caliber", "grain", "coverage", "time", "policy", "none"]


def mutated(t):
    base = t.spread("requests").select("request_id", F.explode(X.lit_list(MUTATIONS)).alias("mutation"), F.col("nl_query").alias("q0"))
    is_ = lambda m: F.col("mutation") == m
    return base.select(
        "request_id", "mutation", F.when(is_("policy"), F.concat(F.lit("raw rows of "), "q0")).otherwise(F.concat(F.lit("report "), "q0")).alias("nl_query"),
        F.when(is_("field"), "not_in_catalog").when(is_("caliber"), "average_unit_price_patched").when(is_("grain"), "order_count").otherwise("average_unit_price").alias("metric_id"),
        F.when(is_("grain"), F.array(F.lit("brand"))).otherwise(F.array(F.lit("region"))).alias("requested"),
        F.when(is_("time"), "2025").otherwise("1997").alias("time_binding"), F.when(is_("coverage"), F.array(F.lit("l_quantity"))).alias("coverage_remove"))


@query("ct_mutation_suite", f"""SELECT mutation, count(*) AS n, CASE failure WHEN '' THEN 'answer' ELSE 'refuse' END AS action, failure AS primary_failure
 FROM (SELECT mutation, CASE WHEN mutation <> 'none' THEN mutation WHEN hit THEN 'policy' ELSE '' END AS failure FROM (SELECT unnest(['field', 'caliber', 'grain', 'coverage', 'time', 'policy', 'none']) AS mutation,
  EXISTS (SELECT 1 FROM ({TRIGGERS}) t WHERE contains(trim(regexp_replace(lower('report ' || nl_query), '\\s+', ' ', 'g')), needle)) AS hit FROM @requests r) y) z GROUP BY 1, 3, 4""")
def _(t):
    patched = [dict(m, metric_id="average_unit_price_patched", formula="SUM(l_extendedprice) / 1") for m in METRICS if m["metric_id"] == "average_unit_price"]
    cat = Catalog(**{**CAT.__dict__, "metrics": METRICS + patched})
    d = C.compile_requests(mutated(t), C.contract_of(t.spark, cat), cat)
    out = d.select("mutation", F.col("decision.action").alias("action"), F.coalesce("decision.trace.certificate.primary_failure", F.lit("")).alias("primary_failure"))
    return out.groupBy("mutation", "action", "primary_failure").agg(F.count(F.lit(1)).alias("n"))


ISOLATION = ["valid", "numerator_edge", "denominator_edge", "numerator_binding", "denominator_binding"]


@query("ct_isolation_suite", f"""WITH k AS (SELECT p_partkey, unnest(['valid', 'numerator_edge', 'denominator_edge', 'numerator_binding', 'denominator_binding']) AS mutation FROM @part_metrics m WHERE p_partkey % 12 = 0),
 ok AS ({DEP} SELECT p_partkey, list_has_all(num, wn) AND list_has_all(den, wd) AS cal FROM g WHERE p_partkey % 12 = 0),
 b AS (SELECT m.p_partkey, count(DISTINCT dependency_node_id) = 2 AND bool_and(physical_node_id IN (SELECT semantic_node_id FROM @part_coverage c)) AS cov FROM @part_metrics m LEFT JOIN @part_bindings b ON b.metric_id = m.metric_id GROUP BY 1)
 SELECT mutation, CASE WHEN mutation IN ('numerator_edge', 'denominator_edge') OR NOT cal THEN 'caliber' WHEN mutation IN ('numerator_binding', 'denominator_binding') OR NOT coalesce(cov, false) THEN 'coverage' ELSE '' END AS primary_failure, count(*) AS n
 FROM k JOIN ok USING (p_partkey) JOIN b USING (p_partkey) GROUP BY 1, 2""")
def _(t):
    kind = F.explode(X.lit_list(ISOLATION))
    tag = lambda c: F.concat_ws("#", c, "mutation")
    m = part_metrics(t).filter(F.size("numerator_nodes") > 0)
    each = m.withColumn("mutation", kind)
    e = t.part_edges.filter("edge_type <> 'measures_of'").join(m.select(F.col("metric_id").alias("dst")), "dst", "left_semi").withColumn("mutation", kind)
    e = e.filter(~((F.col("mutation") == "numerator_edge") & (F.col("edge_type") == "numerator_of")) & ~((F.col("mutation") == "denominator_edge") & (F.col("edge_type") == "denominator_of")))
    b = t.part_bindings.join(m.select("metric_id", "numerator_nodes", "denominator_nodes"), "metric_id").withColumn("mutation", kind)
    b = b.filter(~((F.col("mutation") == "numerator_binding") & F.array_contains("numerator_nodes", F.col("dependency_node_id")))
                 & ~((F.col("mutation") == "denominator_binding") & F.array_contains("denominator_nodes", F.col("dependency_node_id"))))
    marked = each.withColumn("metric_id", tag("metric_id"))
    e = e.select("src", tag("dst").alias("dst"), "edge_type", F.when(F.col("metric_id").isNotNull(), tag("metric_id")).alias("metric_id"))
    b = b.select(tag("metric_id").alias("metric_id"), "dependency_node_id", "physical_node_id")
    v = C.coverage_binding(C.dependency_evidence(marked, e), b, t.part_coverage)
    first = F.when(~C.caliber_passed(), "caliber").when(~F.col("passed"), "coverage").otherwise("")
    return v.groupBy("mutation", first.alias("primary_failure")).agg(F.count(F.lit(1)).alias("n"))


PAIRS = """SELECT request_id * 2 + side AS request_id, request_id AS base, side, nl_query, g_metric AS metric_id, CASE WHEN side = 0 THEN d1 ELSE CASE WHEN request_id % 2 = 0 THEN 'part_type' ELSE 'nation|region' END END AS dims FROM (SELECT *, EXPLODE[0, 1] AS side FROM @requests r0) r8"""


@query("ct_counterfactual_pairs", "WITH " + sql_decisions() + f""" SELECT base, sum(CASE WHEN side = 0 AND f = '' THEN 1 ELSE 0 END)::BIGINT AS base_answered, max(CASE WHEN side = 1 THEN f END) AS counterfactual, max(CASE WHEN side = 1 AND f = '' THEN fin ELSE '' END) AS kept
 FROM (SELECT base, side, fin, concat_ws(',', CASE WHEN a.allowed <> '' AND NOT list_contains(string_split(a.allowed, '|'), fin) THEN 'grain' END, CASE WHEN fin = 'part_type' THEN 'coverage' END,
   CASE WHEN NOT time_ok THEN 'time' END, CASE WHEN phits > 0 OR NOT a.answerable THEN 'policy' END) AS f
  FROM (SELECT *, CASE WHEN dims = 'nation|region' THEN 'nation' ELSE dims END AS fin FROM ({PAIRS}) p) p JOIN mv a USING (metric_id) JOIN (SELECT request_id AS base, time_ok FROM chk) k USING (base)
  JOIN (SELECT r.request_id AS base, count(pid) FILTER (pid NOT IN ('no_governed_metric', 'unsupported_metric')) AS phits FROM r LEFT JOIN hit USING (request_id) GROUP BY 1) h USING (base)) z GROUP BY 1""")
def _(t):
    p = t.spread(PAIRS).withColumn("requested", LIST("dims"))
    d = C.compile_requests(p, C.contract_of(t.spark, CAT), CAT)
    failed = F.coalesce(J("decision.trace.certificate.failed_constraints", ","), F.lit(""))
    return d.groupBy("base").agg(
        F.sum(F.when((F.col("side") == 0) & (failed == ""), 1).otherwise(0)).alias("base_answered"), F.max(F.when(F.col("side") == 1, failed)).alias("counterfactual"),
        F.max(F.when(F.col("side") == 1, J("decision.pred_dimensions")).otherwise("")).alias("kept"))


# --- given plans --------------------------------------------------------------------------------

PLANS = """SELECT request_id, nl_query, CASE WHEN request_id % 19 = 4 THEN 'refuse' ELSE 'answer' END AS action, CASE request_id % 23 WHEN 1 THEN '' WHEN 2 THEN 'ghost' ELSE g_metric END AS metric_id,
 CASE request_id % 4 WHEN 0 THEN d1 WHEN 1 THEN 'region|nation' WHEN 2 THEN concat(d1, '|planet') ELSE 'part_type' END AS dims, CASE WHEN request_id % 37 = 0 THEN 'parse_error' ELSE 'ok' END AS parse_status FROM @requests r0"""
TRIG_RAW = values([(t, t.lower()) for t in dict.fromkeys(x[1] for x in P.trigger_rows(POLICIES, strip=False))], ["trig", "needle"])
def plan_dec(plans):
    """Decisions and violations of plans (request_id, nl_query, action, metric_id, dims, parse_status)."""
    return "WITH " + sql_decisions(plans) + f""", closure AS (SELECT * FROM ({CLOSURE}) cl), pd AS (SELECT request_id, d FROM (SELECT request_id, unnest(string_split(dims, '|')) AS d FROM r) u WHERE d <> ''),
 ok AS (SELECT r.*, metric_id IN (SELECT metric_id FROM mv) AS known FROM r WHERE parse_status = 'ok' AND action = 'answer'),
 th AS (SELECT request_id, string_agg(trig, ',' ORDER BY trig) AS ts FROM r JOIN ({TRIG_RAW}) t ON contains(lower(trim(nl_query)), needle) GROUP BY 1),
 vio AS (SELECT request_id, 'output_not_parseable' AS type, parse_status AS detail FROM r WHERE parse_status <> 'ok'
  UNION ALL SELECT request_id, 'unjustified_refusal', '' FROM r LEFT JOIN th USING (request_id) WHERE parse_status = 'ok' AND action = 'refuse' AND ts IS NULL
  UNION ALL SELECT request_id, 'answer_without_metric', '' FROM ok WHERE metric_id = ''
  UNION ALL SELECT request_id, 'metric_not_in_catalog', metric_id FROM ok WHERE metric_id = 'ghost'
  UNION ALL SELECT request_id, 'unanswerable_metric', metric_id FROM ok WHERE metric_id = 'profit_margin'
  UNION ALL SELECT request_id, 'dimension_not_in_catalog', d FROM ok JOIN pd USING (request_id) WHERE d = 'planet'
  UNION ALL SELECT request_id, 'dimension_not_allowed', d FROM ok JOIN pd USING (request_id) JOIN mv USING (metric_id) WHERE d <> 'planet' AND allowed <> '' AND NOT list_contains(string_split(allowed, '|'), d)
  UNION ALL SELECT request_id, 'finest_grain_violation', c.anc || '>' || c.dim FROM ok JOIN pd a USING (request_id) JOIN pd b USING (request_id) JOIN closure c ON c.dim = a.d AND c.anc = b.d
  UNION ALL SELECT request_id, 'missed_refusal', ts FROM ok JOIN th USING (request_id)
  UNION ALL SELECT request_id, 'physical_coverage_failure', 'p_type' FROM ok JOIN pd USING (request_id) WHERE known AND d = 'part_type'
  UNION ALL SELECT request_id, 'temporal_anchor_failure', anchor FROM ok JOIN tm USING (request_id) JOIN (SELECT request_id, time_ok FROM chk) c USING (request_id) WHERE known AND NOT time_ok
  UNION ALL SELECT request_id, 'missed_refusal', 'policy' FROM ok LEFT JOIN th USING (request_id) JOIN ph USING (request_id) WHERE known AND ts IS NULL)"""


PLAN_DEC = plan_dec(PLANS)


def plans(t):
    p = t.spread(PLANS).withColumn("pred_metric_id", F.col("metric_id")).withColumn("pred_dimensions", LIST("dims")).drop("metric_id", "dims")
    return p


def violations(t):
    return C.validate_plans(plans(t), C.contract_of(t.spark, CAT), CAT, P.trigger_rows(POLICIES, strip=False), ["profit_margin"])


@query("ct_validate_plan", PLAN_DEC + " SELECT * FROM vio")
def _(t):
    v = violations(t).select("request_id", F.explode("violations").alias("v"))
    return v.select("request_id", "v.type", "v.detail")


# The released rule behind a violation type.
RULES = {"metric_not_in_catalog": "use a released metric id", "dimension_not_allowed": "only allowed dimensions", "finest_grain_violation": "keep the finest grain"}


@query("ct_feedback_text", PLAN_DEC + """ SELECT request_id, md5('Plan: ' || action || chr(10) || string_agg(n || '. [' || type || '] rule: ' || CASE type WHEN 'metric_not_in_catalog' THEN 'use a released metric id' WHEN 'dimension_not_allowed' THEN 'only allowed dimensions'
 WHEN 'finest_grain_violation' THEN 'keep the finest grain' ELSE '' END || ' — ' || detail, chr(10) ORDER BY n)) AS feedback FROM (SELECT vio.*, row_number() OVER (PARTITION BY request_id ORDER BY list_position(['output_not_parseable', 'unjustified_refusal',
 'answer_without_metric', 'metric_not_in_catalog', 'unanswerable_metric', 'dimension_not_in_catalog', 'dimension_not_allowed', 'finest_grain_violation', 'missed_refusal', 'caliber_dependency_failure', 'physical_coverage_failure', 'temporal_anchor_failure'], type)
 + CASE WHEN detail = 'policy' THEN 10 ELSE 0 END, list_position(['region', 'nation'], detail)) AS n FROM vio) z JOIN r USING (request_id) GROUP BY request_id, action""")
def _(t):
    f = violations(t).select("request_id", C.feedback_text(F.col("action"), F.col("violations"), RULES).alias("f")).filter("f <> ''")
    return f.select("request_id", F.md5("f").alias("feedback"))


@query("ct_conformance", PLAN_DEC + """ SELECT parse_status, count(*) AS n, sum(a)::BIGINT AS metric_not_in_catalog, round(sum(a) / count(*), 6) AS metric_not_in_catalog_rate, sum(b)::BIGINT AS dimension_not_in_catalog, round(sum(b) / count(*), 6) AS dimension_not_in_catalog_rate,
 sum(c)::BIGINT AS dimension_not_allowed, round(sum(c) / count(*), 6) AS dimension_not_allowed_rate, sum(d)::BIGINT AS finest_grain_violation, round(sum(d) / count(*), 6) AS finest_grain_violation_rate FROM
 (SELECT r.parse_status, (mv.metric_id IS NULL)::INT AS a, contains(dims, 'planet')::INT AS b, coalesce(len(list_filter(string_split(dims, '|'), lambda x: x <> 'planet' AND NOT list_contains(string_split(allowed, '|'), x))) > 0, false)::INT AS c,
  (dims = 'region|nation')::INT AS d FROM r LEFT JOIN mv USING (metric_id) WHERE action <> 'refuse' AND r.metric_id <> '') z GROUP BY 1""")
def _(t):
    return C.conformance(plans(t), C.contract_of(t.spark, CAT), CAT, ["parse_status"])


BASE = "SELECT 'schema' AS mode, request_id, nl_query, 'answer' AS action, g_metric AS metric_id, CASE WHEN request_id % 3 = 0 THEN 'nation|region' ELSE d1 END AS dims FROM @requests r0"


@query("ct_posthoc_baselines", f"""SELECT source_mode, mode, request_id, CASE WHEN blocked IS NULL THEN 'answer' ELSE 'refuse' END AS action, CASE WHEN blocked IS NULL THEN metric_id ELSE '' END AS metric, CASE WHEN blocked IS NULL THEN dims ELSE '' END AS dims, coalesce(blocked, mode || '_accepted_candidate') AS reason
 FROM (SELECT *, CASE WHEN regexp_matches(lower(nl_query), 'select |drop |delete |insert |update |truncate |weather|customer') OR metric_id = 'profit_margin' THEN mode || '_policy_refusal'
  WHEN mode = 'posthoc_answerability_validator' AND dims = 'nation|region' THEN 'posthoc_hierarchy_conflict_no_replan' END AS blocked
  FROM (SELECT mode AS source_mode, request_id, nl_query, metric_id, dims, unnest(['semantic_layer_validator', 'posthoc_answerability_validator']) AS mode FROM ({BASE}) b) c) d""")
def _(t):
    p = t.sql(BASE).withColumn("pred_dimensions", LIST("dims")).withColumn("pred_metric_id", F.col("metric_id"))
    low = F.lower("nl_query")
    refusal = P.contains_any(low, ["select ", "drop ", "delete ", "insert ", "update ", "truncate ", "weather", "customer"]) | (F.col("pred_metric_id") == "profit_margin")
    b = C.posthoc_baselines(p, CAT, refusal)
    return b.select("source_mode", "mode", "request_id", "action", F.col("pred_metric_id").alias("metric"), J("pred_dimensions").alias("dims"), "reason")


@query("ct_failure_certificates", """WITH s AS (SELECT *, string_split(pred_dims, '|') AS p, string_split(expected_dims, '|') AS g, action = 'refuse' OR pred_metric_id = '' AS refused FROM @scored s0),
 w AS (SELECT *, CASE mode WHEN 'schema' THEN 0 ELSE 1 END AS pref, expected_dims = '' OR list_has_all(p, g) AS covers, pred_dims = expected_dims AS same FROM s WHERE mode <> 'compiled'),
 x AS (SELECT *, concat_ws(',', CASE WHEN expected_action = 'refuse' AND NOT refused THEN 'policy_refusal_certificate' END, CASE WHEN covers AND NOT same THEN 'finest_grain_certificate' END, CASE WHEN pred_metric_id <> expected_metric_id THEN 'metric_identity_certificate' END) AS miss
  FROM w WHERE NOT (pred_metric_id = expected_metric_id AND same AND refused = (expected_action = 'refuse'))),
 y AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pref) AS rn FROM x)
 SELECT y.case_id, y.mode, CASE WHEN miss = '' THEN 'coverage_caliber_certificate' ELSE miss END AS missing_witness, c.action AS reference_action, c.pred_metric_id AS reference_metric_id FROM y JOIN s c ON c.case_id = y.case_id AND c.mode = 'compiled' WHERE rn = 1""")
def _(t):
    s = t.scored.withColumn("pred_dimensions", LIST("pred_dims")).withColumn("expected_dimensions", LIST("expected_dims"))
    c = C.failure_certificates(s, ["schema", "guarded"], "compiled")
    return c.select("case_id", "mode", J("missing_witness", ",").alias("missing_witness"), "reference_action", "reference_metric_id")
