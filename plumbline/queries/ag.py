"""Scores and diagnostics."""

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import contract as C, filters as P, scale, scoring as S
from plumbline.plans.governed import POLICIES
from plumbline.queries import query
from plumbline.queries.ct import CAT, DEC, LIST, decided, violations, PLAN_DEC, TRIG_RAW, plan_dec

SET = lambda c: f"list_filter(string_split({c}, '|'), lambda x: x <> '')"
SAME = f"list_sort({SET('pred_dims')}) = list_sort({SET('expected_dims')})"


def flags_sql(src):
    return f"""(SELECT *, action = 'refuse' OR pred_metric_id = '' AS refused, expected_action = 'refuse' AS er, pred_metric_id = expected_metric_id AS mo, {SAME} AS dok, list_has_all({SET('pred_dims')}, {SET('expected_dims')}) AS dr,
 pred_metric_id = expected_metric_id AND {SAME} AS jo FROM {src} s0)"""


FL = flags_sql("@scored")
AVG = lambda c: f"round(avg(({c})::INT), 6)"
CNT = lambda c: f"count(*) FILTER ({c})"
PR = f"round({CNT('refused AND er')} / greatest(1, {CNT('refused')}), 6)"
RC = f"round({CNT('refused AND er')} / greatest(1, {CNT('er')}), 6)"
SCORE = f"count(*) AS n, {AVG('mo')} AS metric_accuracy, {AVG('dok')} AS dimension_accuracy, {AVG('dr')} AS dimension_recall, {AVG('jo')} AS joint_accuracy, {PR} AS refusal_precision, {RC} AS refusal_recall"


def arrays(df):
    return df.withColumn("pred_dimensions", LIST("pred_dims")).withColumn("expected_dimensions", LIST("expected_dims"))


def flags(t, name="scored"):
    return S.flagged(arrays(t.fx(name)))


@query("ag_score_modes", f"SELECT mode, {SCORE}, round({CNT("action = 'answer' AND pred_metric_id <> '' AND execute_ok")} / greatest(1, {CNT("action = 'answer' AND pred_metric_id <> ''")}), 6) AS execution_rate FROM {FL} f GROUP BY 1")
def _(t):
    return flags(t).groupBy("mode").agg(*S.score_columns("execute_ok"))


@query("ag_score_breakdown", f"SELECT mode, query_family, {SCORE} FROM {FL} f GROUP BY GROUPING SETS ((mode), (mode, query_family))")
def _(t):
    f = flags(t)
    return f.groupingSets([[F.col("mode")], [F.col("mode"), F.col("query_family")]], "mode", "query_family").agg(*S.score_columns())


CAT_SQL = """CASE WHEN expected_action <> 'refuse' THEN 'answerable' WHEN regexp_matches(q, 'select |drop |delete |insert |update ') THEN 'sql_or_ddl' WHEN regexp_matches(q, 'email|phone|personal contact|identifier|customer') THEN 'sensitive_or_identifier'
 WHEN regexp_matches(q, 'weather|tomorrow') THEN 'off_domain' WHEN regexp_matches(q, 'unsupported|experimental margin') THEN 'unsupported_metric' ELSE 'policy_denied' END"""


@query("ag_refusal_breakdown", f"SELECT mode, category, count(*) AS n, {CNT('refused AND er')} AS tp, {CNT('refused AND NOT er')} AS fp, {CNT('NOT refused AND er')} AS fn, {PR} AS precision, {RC} AS recall FROM (SELECT *, {CAT_SQL} AS category FROM (SELECT *, lower(nl_query) AS q FROM {FL} f) g) h WHERE refused OR er GROUP BY 1, 2")
def _(t):
    f = flags(t).withColumn("category", P.refusal_category(F.col("nl_query"), F.col("expected_action")))
    return S.refusal_breakdown(f, ["mode", "category"])


ACT = "refused = er"


@query("ag_full_case", f"SELECT mode, count(*) AS n, {AVG(ACT)} AS action, {AVG('mo')} AS metric, {AVG('dok')} AS exact_dim, {AVG('dr')} AS lenient_dim, {AVG(f'{ACT} AND (er OR (mo AND dok))')} AS exact_full, {AVG(f'{ACT} AND (er OR (mo AND dr))')} AS lenient_full FROM {FL} f GROUP BY 1")
def _(t):
    return S.full_case(flags(t), ["mode"])


@query("ag_dedup_score", f"""WITH f AS (SELECT *, trim(regexp_replace(lower(nl_query), '\\s+', ' ', 'g')) AS nq FROM {FL} f0), g AS (SELECT mode, nq, count(DISTINCT (expected_action, expected_metric_id, expected_dims)) AS sigs, min(request_id) AS request_id FROM f GROUP BY 1, 2)
 SELECT mode, {SCORE}, any_value(c) AS conflicts FROM f JOIN g USING (mode, nq, request_id) JOIN (SELECT mode, {CNT('sigs > 1')} AS c FROM g GROUP BY 1) k USING (mode) WHERE sigs = 1 GROUP BY 1""")
def _(t):
    agree, conflict = S.deduplicated(flags(t), ["mode"], "nl_query", "request_id")
    c = conflict.groupBy("mode").agg(F.count(F.lit(1)).alias("conflicts"))
    return agree.groupBy("mode").agg(*S.score_columns()).join(c, "mode", "left").fillna(0, ["conflicts"])


@query("ag_trace_activity", DEC + """ SELECT unnest(['field', 'caliber', 'grain', 'coverage', 'time', 'policy']) AS family, unnest([count(*), count(*), count(*), count(*), count(*), count(*)]) AS n_active,
 unnest([count(*) FILTER (field_ok), count(*), count(*) FILTER (grain_ok), count(*) FILTER (coverage_ok), count(*) FILTER (time_ok), count(*) FILTER (policy_ok)]) AS n_passed,
 unnest([count(*) FILTER (NOT field_ok), 0, count(*) FILTER (NOT grain_ok), count(*) FILTER (NOT coverage_ok), count(*) FILTER (NOT time_ok), count(*) FILTER (NOT policy_ok)]) AS n_failed, 0::BIGINT AS n_inactive FROM chk""")
def _(t):
    return S.trace_activity(decided(t).select(F.col("decision.trace.checks").alias("checks")), C.FAMILIES)


@query("ag_activity_accuracy", f"SELECT mode, layer, request_id % 3 <> 0 AS active, count(*) AS n, {CNT('jo')} AS correct, {AVG('jo')} AS accuracy FROM (SELECT *, query_family AS layer FROM {FL} f) g GROUP BY GROUPING SETS ((mode, layer, request_id % 3 <> 0), (mode, request_id % 3 <> 0))")
def _(t):
    f = flags(t).select("mode", F.col("query_family").alias("layer"), (F.col("request_id") % 3 != 0).alias("active"), "joint_ok")
    g = f.groupingSets([[F.col("mode"), F.col("layer"), F.col("active")], [F.col("mode"), F.col("active")]], "mode", "layer", "active")
    return g.agg(F.count(F.lit(1)).alias("n"), S.yes(F.col("joint_ok")).alias("correct"), S.rate(F.col("joint_ok")).alias("accuracy"))


FATE = """SELECT s.*, k, CASE WHEN request_id % 12 < k THEN concat(expected_metric_id, '|units') ELSE 'other' END AS retrieved, request_id % 9 <> 4 AS validator_pass FROM (SELECT *, EXPLODE[1, 3, 5, 10] AS k FROM @scored s1 WHERE expected_action = 'answer') s"""


@query("ag_candidate_fate", f"""WITH f AS (SELECT *, list_contains(string_split(retrieved, '|'), expected_metric_id) AS here FROM {flags_sql(f'({FATE})')} f0), t AS (SELECT mode, k, count(*) AS tot FROM f GROUP BY 1, 2),
 r AS (SELECT mode, k, unnest(['fate', 'strict', 'cross']) AS part, unnest([CASE WHEN NOT here THEN 'candidate_missing' WHEN jo THEN 'candidate_present_joint_correct' ELSE 'candidate_present_final_wrong' END,
 CASE WHEN NOT here THEN 'candidate_missing' WHEN jo AND validator_pass THEN 'candidate_present_md_correct_validator_pass' ELSE 'candidate_present_final_error' END,
 'candidate_' || CASE WHEN here THEN 'present' ELSE 'missing' END || '__joint_' || CASE WHEN jo THEN 'correct' ELSE 'wrong' END]) AS fate FROM f)
 SELECT mode, k, part, fate, count(*) AS n, round(count(*) / any_value(tot), 6) AS share FROM r JOIN t USING (mode, k) GROUP BY 1, 2, 3, 4""")
def _(t):
    f = S.flagged(arrays(t.sql(FATE))).withColumn("retrieved", LIST("retrieved"))
    return S.candidate_fate(f, ["mode", "k"])


FAM = """CASE WHEN er THEN CASE WHEN regexp_matches(lower(nl_query), 'raw|identifier|select |delete |drop ') THEN 'policy_refusal' ELSE 'unsupported_or_refusal' END WHEN expected_dims <> '' AND dr AND NOT dok THEN 'hierarchy_overexpansion' WHEN NOT mo THEN 'metric_identity' ELSE 'other' END"""


@query("ag_residual_failure", f"""WITH f AS (SELECT *, {FAM} AS family FROM {FL} f0 WHERE NOT er) SELECT mode, NULL AS family, count(*) AS n, {AVG('mo AND dr')} AS available, round({CNT('mo AND dr AND NOT jo')} / greatest(1, {CNT('mo AND dr')}), 6) AS residual FROM f GROUP BY 1
 UNION ALL SELECT mode, family, count(*), NULL, NULL FROM f WHERE mo AND dr AND NOT jo GROUP BY 1, 2""")
def _(t):
    return S.residual_failure(flags(t), ["mode"])


def rounds(t):
    return arrays(t.rounds).withColumn("violations", LIST("violations"))


ENDS = f"""e AS (SELECT request_id, arg_min(violations, round) AS fv, arg_max(violations, round) AS lv FROM @rounds r GROUP BY 1), fx AS (SELECT request_id, unnest({SET('fv')}) AS type FROM e), lx AS (SELECT request_id, unnest({SET('lv')}) AS type FROM e)"""


@query("ag_violation_census", f"""WITH {ENDS}, b AS (SELECT type, fx.request_id IS NOT NULL AS f, lx.request_id IS NOT NULL AS l FROM fx FULL JOIN lx USING (request_id, type)),
 z AS (SELECT * FROM {flags_sql('(SELECT * FROM @rounds r QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY round DESC) = 1)')} q)
 SELECT type, {CNT('f')} AS at_first, {CNT('l')} AS at_last, {CNT('f AND NOT l')} AS fixed, round({CNT('f AND NOT l')} / greatest(1, {CNT('f')}), 6) AS fix_rate, NULL::BIGINT AS n FROM b GROUP BY 1
 UNION ALL SELECT CASE WHEN NOT mo AND dok THEN 'wrong_metric_only' WHEN mo AND NOT dok THEN 'wrong_dimension_set_only' ELSE 'wrong_metric_and_dimensions' END, NULL, NULL, NULL, NULL, count(*) FROM z WHERE violations = '' AND NOT jo GROUP BY 1""")
def _(t):
    r = rounds(t)
    cols = ["violations", "action", "pred_metric_id", "pred_dimensions", "expected_action", "expected_metric_id", "expected_dimensions"]
    last = S.flagged(S.ends(r, ["request_id"], cols).select("last.*"))
    return S.violation_census(r).unionByName(S.invisible_errors(last).withColumnRenamed("kind", "type"), allowMissingColumns=True)


PCOLS = ["action", "pred_metric_id", "pred_dimensions"]
KEYS = ["request_id", "query_family", "expected_action", "expected_metric_id", "expected_dimensions"]


@query("ag_round_state", f"""WITH k AS (SELECT DISTINCT request_id, expected_action, expected_metric_id, expected_dims, unnest([0, 1, 2, 3]) AS k FROM @rounds r),
 s AS (SELECT k.request_id, k, k.expected_action, k.expected_metric_id, k.expected_dims, coalesce(arg_max(r.action, round), 'answer') AS action, coalesce(arg_max(r.pred_metric_id, round), '__parse_error__') AS pred_metric_id, coalesce(arg_max(r.pred_dims, round), '') AS pred_dims
  FROM k LEFT JOIN @rounds r ON r.request_id = k.request_id AND has_prediction AND round <= k GROUP BY ALL) SELECT k, {SCORE} FROM {flags_sql('s')} f GROUP BY 1""")
def _(t):
    s = S.state_by_round(rounds(t), KEYS, PCOLS, 3)
    return S.flagged(s).groupBy("k").agg(*S.score_columns())


@query("ag_transitions", f"""WITH f AS (SELECT request_id, query_family, round, jo FROM {flags_sql('@rounds')} f0), e AS (SELECT request_id, query_family, arg_min(jo, round) AS a, arg_max(jo, round) AS b FROM f GROUP BY 1, 2)
 SELECT query_family, {CNT('NOT a AND b')} AS wrong_to_right, {CNT('a AND NOT b')} AS right_to_wrong, {CNT('a AND b')} AS stayed_right, {CNT('NOT a AND NOT b')} AS stayed_wrong FROM e GROUP BY 1""")
def _(t):
    e = S.ends(S.flagged(rounds(t)), ["request_id", "query_family"], ["joint_ok"])
    return e.groupBy("query_family").agg(*S.transitions(F.col("first.joint_ok"), F.col("last.joint_ok")))


@query("ag_refusal_composition", f"""SELECT mode, NULL AS query_family, {CNT('NOT jo')} AS errors, {CNT('NOT jo AND refused AND NOT er')} AS false_refusals, round({CNT('NOT jo AND refused AND NOT er')} / nullif({CNT('NOT jo')}, 0), 6) AS share FROM {FL} f GROUP BY 1
 UNION ALL SELECT mode, query_family, NULL, count(*), NULL FROM {FL} f WHERE NOT jo AND refused AND NOT er GROUP BY 1, 2""")
def _(t):
    return S.refusal_composition(flags(t), ["mode"], "query_family")


@query("ag_cost", """SELECT query_family, sum(calls)::BIGINT AS calls, round(avg(calls), 6) AS calls_mean, max(calls) AS calls_max, count(*) FILTER (calls = 1) AS resolved_first, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, round(sum(lat) / sum(ln), 6) AS latency_mean
 FROM (SELECT query_family, request_id, count(*) AS calls, sum(prompt_tokens) AS p, sum(completion_tokens) AS c, sum(latency_ms) AS lat, count(*) FILTER (latency_ms > 0) AS ln FROM @rounds r GROUP BY 1, 2) z GROUP BY 1""")
def _(t):
    return S.cost(t.rounds, ["query_family"], "request_id")


@query("ag_latency_percentiles", """WITH v AS (SELECT mode, latency_ms AS x, row_number() OVER (PARTITION BY mode ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY mode) AS n FROM @predictions p)
 SELECT mode, round(median(x), 6) AS median, max(CASE WHEN i = floor(0.95 * (n - 1)) THEN x END) AS p95, max(CASE WHEN i = floor(0.99 * (n - 1)) THEN x END) AS p99, max(x) AS max, round(count(*) * 1000 / sum(x), 6) AS per_second FROM v GROUP BY 1""")
def _(t):
    return S.latency_percentiles(t.predictions, ["mode"], "latency_ms")


@query("ag_nearest_rank_percentiles", """WITH v AS (SELECT lang, n_chars AS x, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
 SELECT lang, max(n) AS n, round(avg(x), 6) AS mean, min(x) AS min, max(CASE WHEN i = ceil(0.5 * n) THEN x END) AS p50, max(CASE WHEN i = ceil(0.95 * n) THEN x END) AS p95, max(x) AS max FROM v GROUP BY 1""")
def _(t):
    return S.nearest_rank(t.documents, ["lang"], "n_chars", 100.0)


@query("ag_parse_status", """SELECT CASE WHEN request_id % 10 = 9 THEN 'missing' WHEN request_id % 6 = 3 THEN 'parse_error' WHEN request_id % 6 IN (0, 1, 2) THEN 'ok' ELSE 'ok_first_brace_block' END AS status, count(*) AS n FROM @requests r GROUP BY 1""")
def _(t):
    got = t.replies.filter("request_id % 10 <> 9").select("request_id", X.parse_reply(F.col("raw_response"))["status"].alias("status"))
    return t.requests.select("request_id").join(got, "request_id", "left").groupBy(F.coalesce("status", F.lit("missing")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


SHAPE = """SELECT o_orderkey, o_orderpriority AS mode, o_orderkey % 17 <> 0 AS parse_ok, CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN 'sum|count' ELSE 'sum' END AS pa, 'sum' AS ga, CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN 'x' ELSE 'x|y' END AS pm, 'y|x' AS gm,
 CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS pd, CASE WHEN o_orderkey % 6 = 0 THEN 'a' ELSE 'b' END AS gd, CASE WHEN o_orderkey % 2 = 0 THEN 't|u|v' ELSE 't' END AS pt, 't|u' AS gt FROM @orders"""
EQ = lambda a, b: f"list_sort({SET(a)}) = list_sort({SET(b)})"


@query("ag_sql_shape_score", f"""SELECT mode, count(*) AS n, {AVG('parse_ok')} AS parse_rate, {AVG(EQ('pa', 'ga'))} AS agg_accuracy, {AVG(EQ('pm', 'gm'))} AS measure_accuracy, {AVG(EQ('pd', 'gd'))} AS dim_accuracy, {AVG(f"list_has_all({SET('pt')}, {SET('gt')})")} AS table_recall,
 {AVG(f"{EQ('pa', 'ga')} AND {EQ('pm', 'gm')} AND {EQ('pd', 'gd')}")} AS joint FROM ({SHAPE}) s GROUP BY 1""")
def _(t):
    d = t.sql(SHAPE)
    for a, b in (("aggs", "a"), ("measures", "m"), ("dims", "d"), ("tables", "t")):
        d = d.withColumn(f"pred_{a}", LIST(f"p{b}")).withColumn(f"gold_{a}", LIST(f"g{b}"))
    return S.sql_shape_score(d, ["mode"])


@query("ag_metric_census", """SELECT sig, count(*) AS cases, coalesce(array_to_string(list_sort(list_distinct(flatten(list(ds)))), '|'), '') AS dims FROM (SELECT substr(sha1(concat(g_metric, '::', tpl)), 1, 12) AS sig, CASE WHEN tpl = 0 THEN [] ELSE [d1, d2] END AS ds FROM @requests r) z GROUP BY 1""")
def _(t):
    none = F.array().cast("array<string>")
    r = t.requests.select(F.substring(F.sha1(F.concat_ws("::", "g_metric", F.col("tpl").cast("string"))), 1, 12).alias("sig"), F.when(F.col("tpl") == 0, none).otherwise(F.array("d1", "d2")).alias("ds"))
    return S.metric_census(r, "sig", "ds").select("sig", "cases", F.coalesce(F.array_join("dims", "|"), F.lit("")).alias("dims"))


FIVE = """SELECT CASE WHEN l_linenumber = 1 THEN l_returnflag END AS a, CASE WHEN l_linenumber = 2 THEN l_linestatus END AS b, CASE WHEN l_quantity > 40 THEN 'big' END AS c, CASE WHEN l_discount = 0 THEN 'full' END AS d, CASE WHEN l_tax > 0 THEN 'taxed' END AS e FROM @lineitem"""


@query("ag_family_counts", f"SELECT coalesce(a, b, c, d, e, 'unknown') AS family, count(*) AS n FROM ({FIVE}) f GROUP BY 1")
def _(t):
    return t.sql(FIVE).groupBy(F.coalesce("a", "b", "c", "d", "e", F.lit("unknown")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


TABLES = ["orders", "documents", "events", "pages", "conversations", "benchmark"]


@query("ag_scale_census", "SELECT layer, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS layer FROM {x}" for x in TABLES) + ") z GROUP BY ROLLUP (layer)")
def _(t):
    one = [getattr(t, x).select(F.lit(x).alias("layer")).groupBy("layer").agg(F.count(F.lit(1)).alias("n")) for x in TABLES]
    every = one[0]
    for d in one[1:]:
        every = every.unionByName(d)
    return every.rollup("layer").agg(F.sum("n").alias("n"))


# What a release printed: scores with three places, of its own copy of the labels, without one of the modes.
RELEASED = {"metric_accuracy": "pred_metric_id = expected_metric_id", "joint_accuracy": "pred_metric_id = expected_metric_id AND same_dims"}
RELEASED_SQL = "SELECT mode, " + ", ".join(f"round(sum(CASE WHEN {c} THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 3) AS {n}" for n, c in RELEASED.items()) + f""",
 round(sum(CASE WHEN er AND refused THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN er THEN 1 ELSE 0 END) AS DOUBLE), 3) AS refusal_recall FROM (SELECT *, expected_action = 'refuse' AS er, action = 'refuse' OR pred_metric_id = '' AS refused, pred_dims = expected_dims AS same_dims FROM @scored s0) s WHERE mode <> 'schema' GROUP BY mode"""


@query("ag_scorer_crosscheck", f"""WITH mine AS (SELECT mode, avg(mo::INT) AS a, avg(jo::INT) AS b, {CNT('refused AND er')} / greatest(1, {CNT('er')})::DOUBLE AS c FROM {FL} f GROUP BY 1), old AS ({RELEASED_SQL}),
 d AS (SELECT mode, greatest(abs(round(a, 6) - metric_accuracy), abs(round(b, 6) - joint_accuracy), abs(round(c, 6) - refusal_recall)) AS diff FROM mine LEFT JOIN old USING (mode))
 SELECT mode, round(diff, 6) AS max_abs_diff, CASE WHEN diff IS NULL THEN 'mode_not_in_released_results' WHEN diff < 1e-9 THEN 'match' ELSE 'MISMATCH' END AS status FROM d""")
def _(t):
    gold = t.gold.select("request_id", "expected_action", "expected_metric_id", "expected_dims")
    own = t.fx("scored").drop("expected_action", "expected_metric_id", "expected_dims").join(gold, "request_id")
    mine = S.flagged(arrays(own)).groupBy("mode").agg(*S.score_columns())
    checked = S.scorer_crosscheck(mine, t.sql(RELEASED_SQL), ["mode"], ["metric_accuracy", "joint_accuracy", "refusal_recall"])
    return checked.select("mode", F.round("max_abs_diff", 6).alias("max_abs_diff"), "status")


GOLD_PLAN = "SELECT request_id, nl_query, expected_action AS action, expected_metric_id AS metric_id, expected_dims AS dims, 'ok' AS parse_status FROM @labelled l"


@query("ag_gold_soundness", plan_dec(GOLD_PLAN)
 + """ SELECT query_family, count(*) AS n, count(v.request_id) AS flagged, count(*) FILTER ((ts IS NOT NULL) <> (expected_action = 'refuse')) AS trigger_mismatch FROM @labelled l LEFT JOIN (SELECT DISTINCT request_id FROM vio) v USING (request_id) LEFT JOIN th USING (request_id) GROUP BY 1""")
def _(t):
    g = t.spread("labelled").select("request_id", "nl_query", "query_family", F.col("expected_action").alias("action"), F.col("expected_metric_id").alias("pred_metric_id"), LIST("expected_dims").alias("pred_dimensions"), F.lit("ok").alias("parse_status"))
    triggers = P.trigger_rows(POLICIES, strip=False)
    v = C.validate_plans(g, C.contract_of(t.spark, CAT), CAT, triggers, ["profit_margin"])
    hit = F.size(P.substring_hits(F.lower(F.trim("nl_query")), triggers)) > 0
    return v.groupBy("query_family").agg(F.count(F.lit(1)).alias("n"), S.yes(F.size("violations") > 0).alias("flagged"), S.yes(hit != (F.col("action") == "refuse")).alias("trigger_mismatch"))


# The plan of every round that has one, numbered so that rounds stay apart.
ROUND_PLAN = "SELECT request_id * 10 + round AS request_id, nl_query, action, pred_metric_id AS metric_id, pred_dims AS dims, 'ok' AS parse_status FROM @rounds r0 WHERE has_prediction"


@query("ag_verdict_drift", plan_dec(ROUND_PLAN) + """, now AS (SELECT request_id, string_agg(type, '|' ORDER BY type) AS types FROM vio GROUP BY 1),
 d AS (SELECT x.request_id, round, array_to_string(list_sort(list_filter(string_split(violations, '|'), lambda v: v <> '')), '|') AS old_types, coalesce(types, '') AS new_types FROM @rounds x LEFT JOIN now ON now.request_id = x.request_id * 10 + round WHERE has_prediction)
 SELECT request_id, round, old_types = '' AS old_pass, new_types = '' AS new_pass, old_types, new_types FROM d WHERE old_types <> new_types""")
def _(t):
    r = t.rounds.filter("has_prediction").withColumn("pred_dimensions", LIST("pred_dims")).withColumn("parse_status", F.lit("ok"))
    stored = r.withColumn("types", LIST("violations")).withColumn("passed", F.size("types") == 0)
    plans = scale.spread(r, "request_id").select("request_id", "round", "nl_query", "action", "pred_metric_id", "pred_dimensions", "parse_status")
    again = C.validate_plans(plans, C.contract_of(t.spark, CAT), CAT, P.trigger_rows(POLICIES, strip=False), ["profit_margin"])
    found = again.withColumn("types", F.transform("violations", lambda v: v["type"])).withColumn("passed", F.size("types") == 0)
    return S.verdict_drift(stored, found, ["request_id", "round"]).select("request_id", "round", "old_pass", "new_pass", F.array_join("old_types", "|").alias("old_types"), F.array_join("new_types", "|").alias("new_types"))


@query("ag_provenance_hash", """SELECT 'mismatch' AS kind, case_id AS k, sha256(concat('{"content":"', replace(nl_query, '"', '\\"'), '","role":"user"}')) AS h, NULL::BIGINT AS n FROM @requests r WHERE request_id % 50 = 7
 UNION ALL SELECT 'digest', '', sha256(concat_ws(',', count(*), """ + ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)" for i in range(8)) + """)), count(*) FROM (SELECT DISTINCT sha256(case_id) AS h FROM @requests r) z""")
def _(t):
    want = F.sha2(F.to_json(F.struct(F.col("nl_query").alias("content"), F.lit("user").alias("role"))), 256)
    r = t.requests.withColumn("expected", want).withColumn("stored", F.when(F.col("request_id") % 50 == 7, F.lit("0")).otherwise(F.col("expected")))
    bad = r.filter("stored <> expected").select(F.lit("mismatch").alias("kind"), F.col("case_id").alias("k"), F.col("expected").alias("h"), F.lit(None).cast("bigint").alias("n"))
    return bad.unionByName(S.id_digest(t.requests, "case_id").select(F.lit("digest").alias("kind"), F.lit("").alias("k"), F.col("digest").alias("h"), "n"))


@query("ag_gate_order", """SELECT query_family, max(ts_utc) FILTER (seq = 0) AS gate, min(ts_utc) FILTER (seq > 0) AS first_run, coalesce(max(ts_utc) FILTER (seq = 0) <= min(ts_utc) FILTER (seq > 0), true) AS ordered FROM @attempts a GROUP BY 1""")
def _(t):
    gate, run = F.max(F.when(F.col("seq") == 0, F.col("ts_utc"))), F.min(F.when(F.col("seq") > 0, F.col("ts_utc")))
    return t.attempts.groupBy("query_family").agg(gate.alias("gate"), run.alias("first_run"), F.coalesce(gate <= run, F.lit(True)).alias("ordered"))


@query("ag_latest_record", """SELECT case_id, reply, error FROM @attempts a QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY error <> '', seq) = 1""")
def _(t):
    return S.latest_record(t.attempts, "case_id", "error", "seq", ["reply", "error"])


SAFE = """SELECT doc_id, CASE WHEN toxic = 1 THEN 'unsafe' ELSE 'safe' END AS gold, CASE WHEN (doc_id % 7 = 0) = (toxic = 1) THEN 'safe' ELSE 'unsafe' END AS pred, concat('L', CAST(quality AS STRING), CAST(toxic AS STRING)) AS label FROM @labels"""
CONF = "count(*) FILTER (pred = 'unsafe' AND gold = 'unsafe') AS tp, count(*) FILTER (pred = 'unsafe' AND gold = 'safe') AS fp, count(*) FILTER (pred = 'safe' AND gold = 'unsafe') AS fn, count(*) FILTER (pred = 'safe' AND gold = 'safe') AS tn"


@query("ag_safety_metrics", f"""SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(tn / nullif(tn + fp, 0), 6) AS specificity
 FROM (SELECT label, count(*) AS n, round(avg((pred = gold)::INT), 6) AS accuracy, {CONF} FROM ({SAFE}) s GROUP BY GROUPING SETS ((label), ())) z""")
def _(t):
    d = t.sql(SAFE)
    return S.safety_metrics(d, ["label"]).unionByName(S.safety_metrics(d).withColumn("label", F.lit(None).cast("string")))


@query("ag_reliability_score", f"""SELECT label, round(secure, 6) AS secure, round(safe, 6) AS safe_secure, round(run, 6) AS exec_acc, round((run * 306 - 0.5 * (acc - run) * 306 - (1 - safe) * 468 - ((1 - secure) * 932 - (1 - safe) * 468)) / 9.32, 6) AS rs
 FROM (SELECT substr(label, 1, 2) AS label, avg((pred = gold)::INT) AS secure, avg(CASE WHEN gold = 'safe' THEN (pred = 'safe')::INT END) AS safe, avg((doc_id % 4 <> 1)::INT) AS acc, avg((doc_id % 4 > 1)::INT) AS run FROM ({SAFE}) s GROUP BY 1) z""")
def _(t):
    d = t.sql(SAFE).withColumn("label", F.substring("label", 1, 2)).withColumn("column_ok", (F.col("doc_id") % 4 != 1).cast("int")).withColumn("exec_ok", (F.col("doc_id") % 4 > 1).cast("int"))
    # The weights of the 932-conversation set.
    return S.reliability_score(d, ["label"], {"all": 932, "safe": 468, "executed": 306, "half": 0.5, "scale": 9.32})


LBL = """SELECT doc_id, concat('verdict: ', CASE doc_id % 5 WHEN 0 THEN 'safe' WHEN 1 THEN 'UNSAFE' WHEN 2 THEN 'not safe' WHEN 3 THEN 'unclear' ELSE 'it is safe' END) AS reply, CASE WHEN toxic = 1 THEN 'unsafe' ELSE 'safe' END AS label1, concat('L', CAST(quality AS STRING)) AS label2 FROM @labels"""


@query("ag_label_accuracy", f"""SELECT label1, label2, count(*) AS n, count(*) FILTER (p = label1) AS correct, round(avg((p = label1)::INT), 6) AS accuracy FROM (SELECT *, CASE WHEN doc_id % 5 IN (0, 4) THEN 'safe' ELSE 'unsafe' END AS p FROM ({LBL}) l WHERE doc_id % 5 <> 3) z GROUP BY GROUPING SETS ((), (label1), (label2))""")
def _(t):
    d = t.sql(LBL).withColumn("p", X.safety_flag(F.col("reply"))).filter("p <> ''")
    ok = F.col("p") == F.col("label1")
    return d.groupingSets([[], [F.col("label1")], [F.col("label2")]], "label1", "label2").agg(F.count(F.lit(1)).alias("n"), S.yes(ok).alias("correct"), S.rate(ok).alias("accuracy"))


@query("ag_verdict_counts", """SELECT annotator, count(*) FILTER (request_id % 7 < 4) AS accept, count(*) FILTER (request_id % 7 IN (4, 5)) AS question, count(*) FILTER (request_id % 7 = 6) AS reject, round(avg((request_id % 7 < 4)::INT), 6) AS accept_rate FROM @annotations a GROUP BY 1""")
def _(t):
    v = F.when(F.col("request_id") % 7 < 4, "accept").when(F.col("request_id") % 7 < 6, "question").otherwise("reject")
    return t.annotations.withColumn("v", v).groupBy("annotator").agg(*[S.yes(F.col("v") == x).alias(x) for x in ("accept", "question", "reject")], S.rate(F.col("v") == "accept").alias("accept_rate"))


@query("ag_disagreement_sensitivity", f"""WITH m AS (SELECT request_id, count(*) FILTER (action = 'refuse') >= 2 AS mref, mode(metric) FILTER (action = 'answer') AS mm, mode(dims) FILTER (action = 'answer') AS md FROM @annotations a GROUP BY 1),
 x AS (SELECT s.*, CASE WHEN mref THEN 'refuse' ELSE 'answer' END AS ma, CASE WHEN mref THEN '' ELSE mm END AS mm2, CASE WHEN mref THEN '' ELSE md END AS md2 FROM @scored s JOIN m USING (request_id)),
 o AS (SELECT mode, CASE WHEN expected_action = 'refuse' THEN r ELSE NOT r AND pred_metric_id = expected_metric_id AND pred_dims = expected_dims END AS a, CASE WHEN ma = 'refuse' THEN r ELSE NOT r AND pred_metric_id = mm2 AND pred_dims = md2 END AS b, (ma, mm2, md2) <> (expected_action, expected_metric_id, expected_dims) AS disputed FROM (SELECT *, action = 'refuse' OR pred_metric_id = '' AS r FROM x) y),
 g AS (SELECT mode, round(avg(a::INT), 6) AS released, round(avg(b::INT), 6) AS sensitivity, count(*) FILTER (a <> b) AS changed, count(*) FILTER (disputed) AS disputed FROM o GROUP BY 1)
 SELECT mode, released, sensitivity, changed, disputed, array_to_string((SELECT list(mode ORDER BY released DESC, mode) FROM g), '|') AS released_rank, array_to_string((SELECT list(mode ORDER BY sensitivity DESC, mode) FROM g), '|') AS sensitivity_rank FROM g""")
def _(t):
    from plumbline.operators import stats

    votes = stats.majority_labels(t.annotations, "request_id")
    f = flags(t).join(votes, "request_id")
    md = LIST("m_dims")
    disputed = (F.col("m_action") != F.col("expected_action")) | (F.col("m_metric") != F.col("expected_metric_id")) | ~S.same_set(md, F.col("expected_dimensions"))
    b = F.when(F.col("m_action") == "refuse", F.col("refused")).otherwise(~F.col("refused") & (F.col("pred_metric_id") == F.col("m_metric")) & S.same_set(F.col("pred_dimensions"), md))
    g = f.select("mode", S.full_ok().alias("a"), F.when(disputed, b).otherwise(S.full_ok()).alias("b"), disputed.alias("d")).groupBy("mode").agg(
        S.rate(F.col("a")).alias("released"), S.rate(F.col("b")).alias("sensitivity"), S.yes(F.col("a") != F.col("b")).alias("changed"), S.yes(F.col("d")).alias("disputed"))
    lists = g.agg(S.rank_list(g, "released").alias("r"), S.rank_list(g, "sensitivity").alias("s")).select(F.array_join("r", "|").alias("released_rank"), F.array_join("s", "|").alias("sensitivity_rank"), F.lit(1).alias("_k"))
    return g.withColumn("_k", F.lit(1)).join(lists, "_k").drop("_k")
