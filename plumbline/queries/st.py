"""Statistics."""

from pyspark.sql import functions as F

from plumbline.operators import joins as JN, scoring as S, stats as ST
from plumbline.queries import query
from plumbline.queries.ag import FL, LIST, arrays, flags, flags_sql

FULL = "CASE WHEN er THEN refused ELSE NOT refused AND jo END"
PAIR = f"(SELECT a.request_id, a.query_family, a.ok AS a, b.ok AS b FROM (SELECT request_id, query_family, mode, {FULL} AS ok FROM {FL} f) a JOIN (SELECT request_id, mode, {FULL} AS ok FROM {FL} f) b USING (request_id) WHERE a.mode = 'guarded' AND b.mode = 'compiled')"
TAIL = "CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))))) END"


def pairs(t, cluster=False):
    f = flags(t).withColumn("ok", S.full_ok())
    p = JN.mode_pair(f, "request_id", "mode", "guarded", "compiled", "ok").withColumnsRenamed({"left": "a", "right": "b"})
    more = t.labelled.select("request_id", "query_family")
    return p.join(more, "request_id")


@query("st_mcnemar_exact", f"SELECT query_family, b, c, round({TAIL}, 9) AS p FROM (SELECT query_family, count(*) FILTER (b AND NOT a) AS b, count(*) FILTER (a AND NOT b) AS c FROM {PAIR} q GROUP BY 1) z")
def _(t):
    g = pairs(t).groupBy("query_family").agg(S.yes(F.col("b") & ~F.col("a")).alias("b"), S.yes(F.col("a") & ~F.col("b")).alias("c"))
    return g.withColumn("p", F.round(ST.mcnemar_p("b", "c"), 9))


def wil(z, s):
    return f"round((p + {z * z} / (2 * n) {s} {z} * sqrt(p * (1 - p) / n + {z * z} / (4 * n * n))) / (1 + {z * z} / n), 6)"


@query("st_wilson_ci", f"SELECT mode, query_family, n, {wil(1.959963984540054, '-')} AS lo, {wil(1.959963984540054, '+')} AS hi, {wil(1.96, '-')} AS lo_short FROM (SELECT mode, query_family, count(*) AS n, avg(jo::INT) AS p FROM {FL} f GROUP BY 1, 2) z")
def _(t):
    g = flags(t).groupBy("mode", "query_family").agg(F.count(F.lit(1)).alias("n"), S.yes(F.col("joint_ok")).alias("k"))
    w, v = ST.wilson(F.col("k"), F.col("n")), ST.wilson(F.col("k"), F.col("n"), 1.96)
    return g.select("mode", "query_family", "n", F.round(w["lo"], 6).alias("lo"), F.round(w["hi"], 6).alias("hi"), F.round(v["lo"], 6).alias("lo_short"))


LP = lambda x: f"(lgamma(a + b + 1) - lgamma({x} + 1) - lgamma(a + b - {x} + 1) + lgamma(c + d + 1) - lgamma(a + c - {x} + 1) - lgamma(c + d - (a + c - {x}) + 1) - (lgamma(a + b + c + d + 1) - lgamma(a + c + 1) - lgamma(b + d + 1)))"
FISHER = f"least(1.0, list_sum(list_transform(list_filter(range(greatest(0, a - d), least(a + b, a + c) + 1), lambda x: {LP('x')} <= {LP('a')} + 1e-9), lambda x: exp({LP('x')}))))"


@query("st_fisher_exact", f"SELECT query_family, a, b, c, d, round({FISHER}, 6) AS p FROM (SELECT query_family, count(*) FILTER (a AND b) AS a, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (NOT a AND b) AS c, count(*) FILTER (NOT a AND NOT b) AS d FROM {PAIR} q GROUP BY 1) z")
def _(t):
    c = ST.contingency(pairs(t), ["query_family"], "a", "b").select("query_family", F.col("both").alias("a"), F.col("left_only").alias("b"), F.col("right_only").alias("c"), F.col("neither").alias("d"))
    return ST.with_fisher(c, "a", "b", "c", "d").withColumn("p", F.round("p", 6))


REPS = 10_000


def boot_sql(kinds, seed, keys):
    """The draw rule in SQL: md5 of seed, keys, replicate and kind; the quantile in the distribution function of the rate."""
    k = ", ".join(keys)
    txt = f"md5(concat_ws('|', '{seed}', {''.join(x + '::VARCHAR, ' for x in keys)}rep::VARCHAR, n::VARCHAR, diff::VARCHAR))"
    return f"""WITH kinds AS MATERIALIZED ({kinds}), rt AS (SELECT DISTINCT units::BIGINT AS l FROM kinds), kk AS (SELECT l, lo, unnest(range(lo, hi + 1)) AS j FROM (SELECT l, greatest(0, l - ceil(10 * sqrt(l))::BIGINT - 20) AS lo, l + ceil(10 * sqrt(l))::BIGINT + 20 AS hi FROM rt) x),
 lg AS (SELECT l, lo, j, sum(CASE WHEN j > lo THEN ln(l / j) ELSE 0 END) OVER (PARTITION BY l ORDER BY j) AS s FROM kk),
 ms AS (SELECT l, lo, j, sum(exp(s - m)) OVER (PARTITION BY l ORDER BY j) AS c FROM (SELECT *, max(s) OVER (PARTITION BY l) AS m FROM lg) y),
 tb AS MATERIALIZED (SELECT l, lo, list(c / t ORDER BY j) AS cdf FROM (SELECT *, max(c) OVER (PARTITION BY l) AS t FROM ms) z GROUP BY l, lo),
 dr AS (SELECT *, (('0x' || substr(h, 1, 8))::BIGINT + 0.5) / 4294967296.0 AS u FROM (SELECT *, {txt} AS h FROM kinds, range(1, {REPS + 1}) r(rep)) x),
 ws AS (SELECT dr.*, lo + len(list_filter(cdf, lambda f: f < u)) AS w FROM dr JOIN tb ON l = units),
 st AS (SELECT {k + ', ' if k else ''}rep, round(sum(w * diff) / nullif(sum(w * n), 0), 9) AS x FROM ws GROUP BY {k + ', ' if k else ''}rep),
 rk AS (SELECT *, row_number() OVER ({'PARTITION BY ' + k if k else ''} ORDER BY x) - 1 AS i, count(*) OVER ({'PARTITION BY ' + k if k else ''}) AS m FROM st WHERE x IS NOT NULL)
 SELECT {k + ', ' if k else ''}max(CASE WHEN i = floor(0.025 * (m - 1)) THEN x END) AS lo, max(CASE WHEN i = floor(0.975 * (m - 1)) THEN x END) AS hi FROM rk {'GROUP BY ' + k if k else ''}"""


CLUSTERED = f"SELECT n, diff, count(*) AS units FROM (SELECT o_custkey, count(*) AS n, sum(b::INT - a::INT)::BIGINT AS diff FROM {PAIR} q JOIN orders ON o_orderkey = request_id GROUP BY 1) z GROUP BY 1, 2"


@query("st_cluster_bootstrap", boot_sql(CLUSTERED, 7, []))
def _(t):
    p = pairs(t).join(t.orders.select(F.col("o_orderkey").alias("request_id"), "o_custkey"), "request_id")
    return ST.bootstrap_interval(ST.unit_kinds(p, [], "o_custkey", "a", "b"), [], REPS, 7)


@query("st_paired_bootstrap", boot_sql(f"SELECT query_family, 1 AS n, b::INT - a::INT AS diff, count(*) AS units FROM {PAIR} q GROUP BY ALL", 11, ["query_family"]))
def _(t):
    k = pairs(t).groupBy("query_family", F.lit(1).alias("n"), (F.col("b").cast("int") - F.col("a").cast("int")).alias("diff")).agg(F.count(F.lit(1)).alias("units"))
    return ST.bootstrap_interval(k, ["query_family"], REPS, 11)


@query("st_contingency", f"""SELECT query_family, count(*) AS n, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS left_only, count(*) FILTER (NOT a AND b) AS right_only, count(*) FILTER (NOT a AND NOT b) AS neither,
 round((count(*) FILTER (a) - count(*) FILTER (b)) / count(*), 6) AS delta FROM {PAIR} q GROUP BY 1""")
def _(t):
    return ST.contingency(pairs(t), ["query_family"], "a", "b")


def fleiss_sql(ans):
    return f"""c AS (SELECT query_family, request_id, {ans} AS v, count(*) AS c FROM @annotations a GROUP BY 1, 2, 3), i AS (SELECT query_family, (sum(c * c) - 3) / 6 AS pi FROM c GROUP BY query_family, request_id),
 o AS (SELECT query_family, count(*) AS items, avg(pi) AS obs FROM i GROUP BY 1), e AS (SELECT query_family, sum(pow(s / (3 * items), 2)) AS ex FROM (SELECT query_family, v, sum(c) AS s FROM c GROUP BY 1, 2) q JOIN o USING (query_family) GROUP BY 1)"""


@query("st_fleiss_kappa", f"WITH {fleiss_sql('option')} SELECT query_family, items, round(CASE WHEN ex < 1 THEN (obs - ex) / (1 - ex) ELSE 1 END, 6) AS kappa, round(obs, 6) AS observed, round(ex, 6) AS expected FROM o JOIN e USING (query_family)")
def _(t):
    return ST.fleiss_kappa(t.annotations, "request_id", "option", ["query_family"])


@query("st_cohen_kappa", """WITH w AS (SELECT request_id, max(CASE WHEN annotator = 'A' THEN option END) AS a, max(CASE WHEN annotator = 'B' THEN option END) AS b, max(CASE WHEN annotator = 'C' THEN option END) AS c FROM @annotations x GROUP BY 1),
 p AS (SELECT 'A-B' AS pair, a AS l, b AS r FROM w UNION ALL SELECT 'A-C', a, c FROM w UNION ALL SELECT 'B-C', b, c FROM w), n AS (SELECT pair, count(*) AS n, avg((l = r)::INT) AS obs FROM p GROUP BY 1),
 e AS (SELECT pair, sum(x * y) / (any_value(n) * any_value(n)) AS ex FROM (SELECT pair, l AS v, count(*) AS x FROM p GROUP BY 1, 2) s JOIN (SELECT pair, r AS v, count(*) AS y FROM p GROUP BY 1, 2) u USING (pair, v) JOIN n USING (pair) GROUP BY 1)
 SELECT pair, n, round(obs, 6) AS agreement, round((obs - ex) / (1 - ex), 6) AS kappa FROM n JOIN e USING (pair)""")
def _(t):
    return ST.cohen_kappa(t.annotations, "request_id", "annotator", "option", [("A", "B"), ("A", "C"), ("B", "C")])


@query("st_majority_vote", """WITH m AS (SELECT request_id, any_value(query_family) AS query_family, any_value(expected_action) AS ea, any_value(expected_metric_id) AS em, any_value(expected_dims) AS ed, CASE WHEN count(*) FILTER (action = 'refuse') >= 2 THEN 'refuse' ELSE 'answer' END AS ma,
  mode(metric) FILTER (action = 'answer') AS mm, mode(dims) FILTER (action = 'answer') AS md, count(DISTINCT action) = 1 AS una, count(*) FILTER (uncertain <> '') AS unc FROM @annotations a GROUP BY 1)
 SELECT query_family, count(*) AS n, round(avg((ma = ea)::INT), 6) AS action_agreement, round(avg(una::INT), 6) AS unanimous, round(avg(CASE WHEN ma = 'answer' THEN (mm = em)::INT END), 6) AS metric_agreement, round(avg(CASE WHEN ma = 'answer' THEN (md = ed)::INT END), 6) AS dims_agreement,
 count(*) FILTER (ma <> ea OR (ma = 'answer' AND (mm <> em OR md <> ed))) AS disagreements, sum(unc)::BIGINT AS uncertain FROM m GROUP BY 1""")
def _(t):
    a = t.annotations
    per = a.groupBy("request_id").agg(F.max("query_family").alias("query_family"), F.max("expected_action").alias("ea"), F.max("expected_metric_id").alias("em"), F.max("expected_dims").alias("ed"),
                                      (F.min("action") == F.max("action")).alias("una"), S.yes(F.col("uncertain") != "").alias("unc"))
    j = per.join(ST.majority_labels(a, "request_id"), "request_id")
    ans = F.col("m_action") == "answer"
    m, d = F.col("m_metric") == F.col("em"), F.col("m_dims") == F.col("ed")
    among = lambda c: F.round(F.avg(F.when(ans, F.when(c, 1.0).otherwise(0.0))), 6)
    act = F.col("m_action") == F.col("ea")
    return j.groupBy("query_family").agg(F.count(F.lit(1)).alias("n"), S.rate(act).alias("action_agreement"), S.rate(F.col("una")).alias("unanimous"), among(m).alias("metric_agreement"), among(d).alias("dims_agreement"),
                                         S.yes(~act | (ans & (~m | ~d))).alias("disagreements"), F.sum("unc").alias("uncertain"))


@query("st_binding_agreement", """WITH c AS (SELECT request_id, option, count(*) AS c, split_part('A|B|C|D|E', '|', (1 + request_id % 5)::INT) AS k FROM @annotations a GROUP BY ALL), i AS (SELECT request_id, arg_max(option, c) AS top, max(c) AS c, any_value(k) AS k, coalesce(sum(c) FILTER (option = 'E'), 0) AS e FROM c GROUP BY 1)
 SELECT count(*) AS items, round(avg((c = 3)::INT), 6) AS all_agree, round(avg((c >= 2 AND top = k)::INT), 6) AS majority_right, round(sum(e) / (3 * count(*)), 6) AS abstain_rate, count(*) FILTER (c < 3 OR top <> k) AS disagreements FROM i""")
def _(t):
    a = t.annotations.withColumn("key", F.split_part(F.lit("A|B|C|D|E"), F.lit("|"), (1 + F.col("request_id") % 5).cast("int")))
    return ST.binding_agreement(a, "request_id", "option", "key")


TUP = ["action", "pred_metric_id", "pred_dims"]
CELL = "SELECT request_id, action, pred_metric_id, pred_dims, count(*) AS c, min(sample_idx) AS fst FROM @samples s GROUP BY 1, 2, 3, 4"


@query("st_plurality", f"SELECT request_id, action, pred_metric_id, pred_dims, c AS c1 FROM ({CELL}) c QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY c DESC, fst) = 1")
def _(t):
    return ST.sample_profile(t.samples, ["request_id"], TUP, 5).select("request_id", "plurality.*", "c1")


@query("st_sample_entropy", f"SELECT request_id, round(abs(sum(-(c / 5.0) * log2(c / 5.0))), 6) AS entropy, count(*) AS distinct_answers, max(c) = 5 AS unanimous FROM ({CELL}) c GROUP BY 1")
def _(t):
    return ST.sample_profile(t.samples, ["request_id"], TUP, 5).select("request_id", "entropy", "distinct_answers", (F.col("c1") == 5).alias("unanimous"))


PLU = f"(SELECT c.*, query_family, expected_action, expected_metric_id, expected_dims FROM ({CELL}) c JOIN @labelled l USING (request_id) QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY c DESC, fst) = 1)"


@query("st_abstention_arms", f"""WITH p AS (SELECT query_family, c AS c1, {FULL} AS ok FROM {flags_sql(PLU)} f), x AS (SELECT arm, query_family, c1 < lim AS ab, ok FROM p, (VALUES ('unanimous', 5), ('majority', 3), ('any', 0)) v(arm, lim)),
 g AS (SELECT arm, query_family, count(*) AS n, count(*) FILTER (ab AND NOT ok) AS a, count(*) FILTER (NOT ab AND NOT ok) AS b, count(*) FILTER (ab AND ok) AS c, count(*) FILTER (NOT ab AND ok) AS d FROM x GROUP BY GROUPING SETS ((arm, query_family), (arm)))
 SELECT g.arm, g.query_family, g.n, round((g.a + g.c) / g.n, 6) AS abstention, round(g.d / nullif(g.b + g.d, 0), 6) AS answered_accuracy, round(g.a / nullif(g.a + g.b, 0), 6) AS coverage, round(g.a / nullif(g.a + g.b, 0) / nullif((o.a + o.c) / o.n, 0), 6) AS lift,
 round(g.c / nullif(g.c + g.d, 0), 6) AS false_abstention, pv.p FROM g JOIN (SELECT * FROM g WHERE query_family IS NULL) o USING (arm) JOIN (SELECT arm, query_family, round({FISHER}, 6) AS p FROM g) pv ON pv.arm = g.arm AND pv.query_family IS NOT DISTINCT FROM g.query_family""")
def _(t):
    p = ST.sample_profile(t.samples, ["request_id"], TUP, 5).select("request_id", "plurality.*", "c1")
    c = S.flagged(arrays(p.join(t.labelled.drop("nl_query"), "request_id"))).select("query_family", "c1", S.full_ok().alias("full_ok"))
    return ST.abstention_arms(c, {"unanimous": 5, "majority": 3, "any": 0}, "query_family")


@query("st_threshold_branch", f"""SELECT mode, round(acc, 6) AS acc, CASE WHEN acc >= 0.95 THEN 'a_external_anchor_holds' WHEN acc >= 0.8 THEN 'b_case_level_divergence' ELSE 'c_compilability_boundary' END AS branch FROM (SELECT mode, avg(jo::INT) AS acc FROM {FL} f GROUP BY 1) z""")
def _(t):
    g = flags(t).groupBy("mode").agg(F.avg(F.col("joint_ok").cast("int")).alias("acc"))
    b = ST.branch([(F.col("acc") >= 0.95, "a_external_anchor_holds"), (F.col("acc") >= 0.8, "b_case_level_divergence")], "c_compilability_boundary")
    return g.select("mode", F.round("acc", 6).alias("acc"), b.alias("branch"))


@query("st_cross_pass", """WITH s AS (SELECT request_id, sample_idx, concat_ws('/', action, pred_metric_id, pred_dims) AS ans, action = expected_action AND pred_metric_id = expected_metric_id AND pred_dims = expected_dims AS ok FROM @samples s0),
 c AS (SELECT request_id, ans, count(*) AS c, bool_or(ok) AS ok, min(sample_idx) AS f FROM s GROUP BY 1, 2), i AS (SELECT request_id, max(c) AS c, arg_max(ans, c) AS top, arg_max(ok, c) AS ok, arg_min(ans, f) AS one FROM c GROUP BY 1)
 SELECT count(*) AS n, round(avg((c = 5)::INT), 6) AS agree, round(avg((c >= 3 AND ok)::INT), 6) AS majority_right, count(*) FILTER (c < 3 OR top <> one) AS flips FROM i""")
def _(t):
    s = t.samples.withColumn("ans", F.concat_ws("/", *TUP)).withColumn("ok", F.expr("action = expected_action AND pred_metric_id = expected_metric_id AND pred_dims = expected_dims"))
    return ST.cross_pass(s, "request_id", "sample_idx", "ans", "ok")
