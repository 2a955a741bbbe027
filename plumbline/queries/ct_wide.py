"""Decisions over a catalog of 1,800 metrics and 2,400 dimensions: copies of the governed one that requests name by number."""

from pyspark.sql import functions as F

from plumbline.fixtures import values
from plumbline.operators import contract as C, filters as P
from plumbline.plans.governed import DIMENSIONS, METRICS, POLICIES, catalog
from plumbline.queries import query
from plumbline.queries.ct import CAT, J, LIST, TRIG_RAW, TRIGGERS, outcome, sql_outcome
from plumbline.sources.catalog import Catalog

METRIC_COPIES, DIMENSION_COPIES = 200, 240


def wide() -> Catalog:
    """Copy i of a dimension is named "<name> i" and lies below copy i of its parent; copy i of a metric allows the originals and copy i."""
    dims = list(DIMENSIONS)
    for i in range(1, DIMENSION_COPIES):
        dims += [dict(d, dimension_id=f"{d['dimension_id']}_{i}", name=f"{d['name']} {i}", aliases=[f"{a} {i}" for a in d["aliases"]], parent=f"{d['parent']}_{i}" if d["parent"] else "") for d in DIMENSIONS]
    metrics = list(METRICS)
    for i in range(1, METRIC_COPIES):
        metrics += [dict(m, metric_id=f"{m['metric_id']}_{i}", allowed_dimensions=m["allowed_dimensions"] + [f"{d}_{i}" for d in m["allowed_dimensions"]]) for m in METRICS]
    return Catalog(**{**catalog().__dict__, "dimensions": dims, "metrics": metrics})


WIDE = wide()
# The request names two numbered copies beside what it named before; one in 29 asks for a metric nobody has.
RAW = f"""SELECT request_id, concat(nl_query, ' by ', n1, ' ', CAST(k AS STRING), ' and ', n2, ' ', CAST(k2 AS STRING)) AS nl_query,
 CASE WHEN request_id % 29 = 7 THEN 'ghost' WHEN k < {METRIC_COPIES} THEN concat(g_metric, '_', CAST(k AS STRING)) ELSE g_metric END AS metric_id, d1, d2, k, k2
 FROM (SELECT *, replace(d1, '_', ' ') AS n1, replace(d2, '_', ' ') AS n2, 1 + request_id % {DIMENSION_COPIES - 1} AS k, CASE WHEN request_id % 3 = 0 THEN 1 + request_id % 7 ELSE 1 + request_id % {DIMENSION_COPIES - 1} END AS k2 FROM @requests r0) w"""

ALIASES = values([(d["dimension_id"], d["grain_rank"], " ".join(a.lower().split())) for d in WIDE.dimensions for a in dict.fromkeys([d["dimension_id"], d["name"], *d["aliases"]])], ["dim", "rk", "alias"])
CLOSURE = values([(d, a) for d, up in WIDE.closure().items() for a in up], ["dim", "anc"])
METRIC_V = values([(m["metric_id"], "|".join(m["allowed_dimensions"]), str(m["answerable"]).lower(), str(m["temporal_anchor_required"]).lower()) for m in WIDE.metrics],
                  ["metric_id", "allowed", "answerable", "temporal"])


def cut(m, n):
    return f"WHEN contains(q, '{m}') THEN nullif(substr(q, strpos(q, '{m}') + {n}), '')"


MARK = " ".join(cut(m, len(m)) for m in C.MARKERS)


def sql_decisions(raw):
    """The rules in SQL; distinct texts only meet the aliases that begin with one of their words (or any odd alias)."""
    return f"""r AS (SELECT *, trim(regexp_replace(lower(nl_query), '\\s+', ' ', 'g')) AS q FROM ({raw}) r1),
 s AS (SELECT *, coalesce(coalesce(CASE {MARK} END, CASE {cut('按', 1)} END, CASE WHEN contains(q, 'breakdown for') THEN nullif(substr(q, 1, strpos(q, 'breakdown for') - 1), '') END,
   CASE WHEN regexp_matches(q, 'monthly|quarterly|valid time anchor|with the valid time') THEN q END)
   || CASE WHEN contains(q, 'monthly') THEN ' monthly month' ELSE '' END || CASE WHEN contains(q, 'quarterly') THEN ' quarterly quarter' ELSE '' END, '') AS scope FROM r),
 al AS MATERIALIZED (SELECT *, regexp_full_match(alias, '[a-z0-9_ ]+') AS plain, CASE WHEN regexp_full_match(alias, '[a-z0-9_ ]+') THEN regexp_extract(alias, '[a-z0-9_]+') ELSE regexp_extract(alias, '[^a-z0-9_ ]') END AS w1 FROM ({ALIASES}) a0),
 ds AS MATERIALIZED (SELECT scope, unnest(list_distinct(list_concat(regexp_extract_all(scope, '[a-z0-9_]+'), regexp_extract_all(scope, '[^a-z0-9_ ]')))) AS w1 FROM (SELECT DISTINCT scope FROM s) d0),
 dn AS MATERIALIZED (SELECT DISTINCT scope, dim, rk FROM ds JOIN al USING (w1) WHERE contains(scope, alias) AND (NOT plain OR contains(' ' || regexp_replace(scope, '[^a-z0-9_]', ' ', 'g') || ' ', ' ' || alias || ' '))),
 dm AS (SELECT request_id, dim, rk FROM s JOIN dn USING (scope)),
 cl AS MATERIALIZED (SELECT * FROM ({CLOSURE}) c0),
 over AS (SELECT DISTINCT o.request_id, c.anc AS dim FROM dm o JOIN cl c ON o.dim = c.dim),
 fin AS (SELECT dm.* FROM dm ANTI JOIN over ON dm.request_id = over.request_id AND dm.dim = over.dim),
 da AS (SELECT request_id, string_agg(dim, '|' ORDER BY rk, dim) AS requested FROM dm GROUP BY 1),
 fa AS (SELECT request_id, string_agg(dim, '|' ORDER BY rk, dim) AS resolved, bool_or(dim LIKE 'part_type%') AS uncovered FROM fin GROUP BY 1),
 mv AS MATERIALIZED (SELECT * FROM ({METRIC_V}) v0),
 ba AS (SELECT fin.request_id, string_agg(dim, '|' ORDER BY dim) AS barred FROM fin JOIN r USING (request_id) JOIN mv USING (metric_id)
   WHERE allowed <> '' AND NOT list_contains(string_split(allowed, '|'), dim) GROUP BY 1),
 hit AS (SELECT DISTINCT request_id, pid, trig FROM r JOIN ({TRIGGERS}) t ON contains(q, needle)
   UNION SELECT request_id, 'sensitive', 'ambiguous_query' FROM r WHERE q = 'show me the numbers'
   UNION SELECT request_id, 'no_governed_metric', 'empty_metric_candidate' FROM r ANTI JOIN mv USING (metric_id)
   UNION SELECT request_id, 'unsupported_metric', metric_id FROM r JOIN mv USING (metric_id) WHERE NOT answerable),
 ph AS (SELECT request_id, string_agg(pid || ':' || trig, '|' ORDER BY pid, trig) AS hits FROM hit GROUP BY 1),
 tm AS (SELECT request_id, CASE WHEN regexp_matches(q, '(^|[^a-z0-9_])last year([^a-z0-9_]|$)') OR contains(q, '去年') THEN 'last_year'
   WHEN regexp_matches(q, '(^|[^a-z0-9_])199[5-9]([^a-z0-9_]|$)') THEN regexp_extract(q, '(199[5-9])', 1)
   WHEN regexp_matches(q, '\\b20[0-9]{{2}}\\b') THEN regexp_extract(q, '\\b(20[0-9]{{2}})\\b', 1) ELSE '2000' END AS anchor FROM r),
 chk AS (SELECT r.request_id, r.metric_id, coalesce(requested, '') AS requested, coalesce(resolved, '') AS resolved, coalesce(barred, '') AS barred, coalesce(hits, '') AS hits, anchor,
   mv.metric_id IS NOT NULL AS field_ok, barred IS NULL AS grain_ok, NOT coalesce(uncovered, false) AS coverage_ok, (anchor IN ('1995','1996','1997','1998','1999','2000','2001','last_year')) AS time_ok, hits IS NULL AS policy_ok
   FROM r LEFT JOIN da USING (request_id) LEFT JOIN fa USING (request_id) LEFT JOIN ba USING (request_id) LEFT JOIN ph USING (request_id) LEFT JOIN tm USING (request_id) LEFT JOIN mv ON r.metric_id = mv.metric_id)"""


FAILED = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT {f}_ok THEN '{f}' END" for f in ("field", "grain", "coverage", "time", "policy")) + ")"


def decided(t, raw=RAW, **kw):
    return C.compile_requests(t.spread(raw), C.contract_of(t.spark, WIDE), WIDE, **kw)


@query("ct_compile_wide", "WITH " + sql_decisions(RAW) + f""", o AS ({sql_outcome(FAILED)}) SELECT o.*, requested, barred FROM o JOIN chk USING (request_id)""")
def _(t):
    grain = "decision.trace.checks.grain"
    return outcome(decided(t), J(f"{grain}.requested").alias("requested"), J(f"{grain}.disallowed").alias("barred"))


CAND = f"""SELECT request_id * 10 + rank AS request_id, request_id AS case_key, rank, nl_query, CASE rank WHEN 1 THEN CASE WHEN request_id % 3 = 0 THEN concat('profit_margin_', CAST(1 + request_id % {METRIC_COPIES - 1} AS STRING)) ELSE metric_id END
 WHEN 2 THEN metric_id ELSE concat('average_unit_price_', CAST(1 + request_id % {METRIC_COPIES - 1} AS STRING)) END AS metric_id FROM (SELECT *, EXPLODE[1, 2, 3] AS rank FROM ({RAW}) w0) r9"""


@query("ct_candidates_wide", "WITH " + sql_decisions(CAND) + f""" SELECT case_key, metric_id, f = '' AS passed, CAST(rank AS BIGINT) AS rank FROM (SELECT case_key, chk.metric_id, rank, {FAILED} AS f,
 row_number() OVER (PARTITION BY case_key ORDER BY {FAILED} <> '', rank) AS rn FROM chk JOIN (SELECT request_id, case_key, rank FROM r) k USING (request_id)) z WHERE rn = 1""")
def _(t):
    b = C.compile_candidates(t.spread(CAND), C.contract_of(t.spark, WIDE), WIDE, "case_key")
    return b.select("case_key", "metric_id", (F.col("decision.action") == "answer").alias("passed"), F.col("rank").cast("bigint").alias("rank"))


PLANS = f"""SELECT request_id, nl_query, 'answer' AS action, metric_id, CASE request_id % 4 WHEN 0 THEN concat(d1, '_', CAST(k AS STRING)) WHEN 1 THEN concat('region_', CAST(k AS STRING), '|nation_', CAST(k AS STRING))
 WHEN 2 THEN concat(d1, '_', CAST(k AS STRING), '|planet') ELSE concat('year_', CAST(k AS STRING), '|month_', CAST(k AS STRING), '|quarter_', CAST(k2 AS STRING)) END AS dims, 'ok' AS parse_status FROM ({RAW}) w0"""


@query("ct_validate_wide", "WITH " + sql_decisions(PLANS) + f""", pd AS (SELECT request_id, metric_id, unnest(string_split(dims, '|')) AS d FROM r), known AS (SELECT DISTINCT dim AS d FROM ({ALIASES}) k0), km AS (SELECT r.* FROM r SEMI JOIN mv USING (metric_id)),
 th AS (SELECT request_id, string_agg(trig, ',' ORDER BY trig) AS ts FROM r JOIN ({TRIG_RAW}) t ON contains(lower(trim(nl_query)), needle) GROUP BY 1)
 SELECT request_id, 'metric_not_in_catalog' AS type, metric_id AS detail FROM r ANTI JOIN mv USING (metric_id)
 UNION ALL SELECT request_id, 'unanswerable_metric', metric_id FROM r WHERE metric_id LIKE 'profit_margin%'
 UNION ALL SELECT request_id, 'dimension_not_in_catalog', d FROM pd ANTI JOIN known USING (d)
 UNION ALL SELECT request_id, 'dimension_not_allowed', d FROM pd SEMI JOIN known USING (d) JOIN mv USING (metric_id) WHERE allowed <> '' AND NOT list_contains(string_split(allowed, '|'), d)
 UNION ALL SELECT a.request_id, 'finest_grain_violation', a.d || '>' || b.d FROM pd b JOIN cl ON cl.dim = b.d JOIN pd a ON a.request_id = b.request_id AND a.d = cl.anc
 UNION ALL SELECT request_id, 'missed_refusal', ts FROM r JOIN th USING (request_id)
 UNION ALL SELECT request_id, 'physical_coverage_failure', 'p_type' FROM km WHERE regexp_matches(dims, '(^|[|])part_type_')
 UNION ALL SELECT request_id, 'temporal_anchor_failure', anchor FROM km JOIN tm USING (request_id) JOIN (SELECT request_id, time_ok FROM chk) c USING (request_id) WHERE NOT time_ok
 UNION ALL SELECT request_id, 'missed_refusal', 'policy' FROM km LEFT JOIN th USING (request_id) JOIN ph USING (request_id) WHERE ts IS NULL""")
def _(t):
    p = t.spread(PLANS).withColumn("pred_metric_id", F.col("metric_id")).withColumn("pred_dimensions", LIST("dims")).drop("metric_id", "dims")
    unanswerable = [m["metric_id"] for m in WIDE.metrics if not m["answerable"]]
    v = C.validate_plans(p, C.contract_of(t.spark, WIDE), WIDE, P.trigger_rows(POLICIES, strip=False), unanswerable).select("request_id", F.explode("violations").alias("v"))
    return v.select("request_id", "v.type", "v.detail")
