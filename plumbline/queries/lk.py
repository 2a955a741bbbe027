"""Lexical linking and retrieval."""

from pyspark.sql import functions as F, types as T

from plumbline.fixtures import values
from plumbline.functions import text as X
from plumbline.operators import contract as C, filters as P, linking as L, scale
from plumbline.plans.governed import DIMENSIONS, METRICS, POLICIES
from plumbline.queries import query
from plumbline.queries.ct import CAT, DEC, LIST, sql_failed
from plumbline.sources.catalog import METRIC_SCHEMA, rows_of

J = lambda c, sep="|": F.array_join(c, sep)
TOKENS = lambda e: f"list_distinct(list_concat(regexp_extract_all({e}, '[a-z0-9_]+'), regexp_extract_all({e}, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}')))"
PAIRS = lambda e: f"list_distinct(list_concat(regexp_extract_all({e}, '(?s)..'), regexp_extract_all(substr({e}, 2), '(?s)..')))"
SQUEEZE = lambda e: f"regexp_replace({e}, '\\s+', '', 'g')"


@query("lk_tokenize", f"SELECT doc_id, len(tk) AS n, md5(array_to_string(list_sort(tk), ' ')) AS h FROM (SELECT doc_id, {TOKENS('lower(text)')} AS tk FROM documents)")
def _(t):
    d = t.spread("documents", "doc_id").select("doc_id", X.tokens(F.col("text")).alias("tk"))
    return d.select("doc_id", F.size("tk").cast("bigint").alias("n"), F.md5(J(F.sort_array("tk"), " ")).alias("h"))


@query("lk_char_bigrams", f"SELECT doc_id, len(a) AS n, md5(array_to_string(list_sort(a), ' ')) AS h, len(b) AS n_blanks FROM (SELECT doc_id, {PAIRS(SQUEEZE('lower(text)'))} AS a, {PAIRS('lower(text)')} AS b FROM documents)")
def _(t):
    d = t.spread("documents", "doc_id").select("doc_id", X.bigrams(F.col("text")).alias("a"), X.bigrams(F.col("text"), True).alias("b"))
    return d.select("doc_id", F.size("a").cast("bigint").alias("n"), F.md5(J(F.sort_array("a"), " ")).alias("h"), F.size("b").cast("bigint").alias("n_blanks"))


COPIES = 8


def with_copies():
    """The catalog beside copies of it whose names carry a distractor prefix; `lk_wide` has two hundred."""
    out = list(METRICS)
    for i in range(1, COPIES):
        out += [dict(m, metric_id=f"copy_{i}_{m['metric_id']}", metric_name=f"distractor {i} {m['metric_name']}", aliases=[f"distractor {i} {a}" for a in m["aliases"]]) for m in METRICS]
    return out


def field_values(weights, metrics=METRICS):
    rows = []
    for m in metrics:
        for c, w in weights:
            rows += [(m["metric_id"], v.lower().strip(), w) for v in (m[c] if isinstance(m[c], list) else [m[c]]) if v.strip()]
    return values(rows, ["metric_id", "field", "w"])


def score_sql(weights, phrase, bigram, blanks, name="sc", metrics=METRICS, requests="@requests"):
    sq = (lambda e: e) if blanks else SQUEEZE
    b = f" + coalesce({bigram} * CAST(w AS DOUBLE) * len(list_intersect(qb, fb)) / nullif(sqrt(len(fb)), 0), 0)" if bigram else ""
    return f"""u AS (SELECT q, {TOKENS('q')} AS qt, {PAIRS(sq('q'))} AS qb FROM (SELECT DISTINCT lower(trim(nl_query)) AS q FROM {requests} r0)),
 fv AS (SELECT *, {TOKENS('field')} AS ft, {PAIRS(sq('field'))} AS fb FROM ({field_values(weights, metrics)}) f0),
 uq AS (SELECT q, metric_id, round(sum({phrase} * CAST(w AS DOUBLE) * contains(q, field)::INT + CAST(w AS DOUBLE) * len(list_intersect(qt, ft)){b}), 6) AS score FROM u JOIN fv ON true GROUP BY 1, 2),
 {name} AS (SELECT request_id, metric_id, score FROM {requests} r1 JOIN uq ON uq.q = lower(trim(nl_query)) WHERE score > 0)"""


def catalog_fields(t, weights):
    return L.field_rows(CAT.metric_rows(t.spark), weights)


def scores(t, weights=L.METRIC_WEIGHTS, **kw):
    return L.text_scores(t.spread("requests"), "request_id", "nl_query", catalog_fields(t, weights), **kw)


@query("lk_text_score", "WITH " + score_sql(L.METRIC_WEIGHTS, 5, 1, False) + " SELECT * FROM sc")
def _(t):
    return scores(t)


@query("lk_text_score_light", "WITH " + score_sql(L.LIGHT_WEIGHTS, 4, 0.1, True) + " SELECT * FROM sc")
def _(t):
    return scores(t, L.LIGHT_WEIGHTS, phrase=4.0, bigram=0.1, blanks=True)


@query("lk_text_score_nobigram", "WITH " + score_sql([("metric_name", 2.0), ("formula", 2.0), ("description", 3.0)], 5, 0, False) + " SELECT * FROM sc")
def _(t):
    return scores(t, [("metric_name", 2.0), ("formula", 2.0), ("description", 3.0)], bigram=0.0)


# Cue terms that lift a metric.
BOOSTS = [("order_count", ["order count", "orders", "transactions"], 8.0), ("customer_count", ["buyers", "clients"], 30.0), ("profit_margin", ["gross margin", "profit margin"], 5.0)]
BOOST_SQL = "SELECT request_id, metric_id, sum(score) AS score FROM (SELECT * FROM sc UNION ALL " + " UNION ALL ".join(
    f"SELECT request_id, '{m}', {x} FROM @requests b0 WHERE regexp_matches(lower(nl_query), '{'|'.join(terms)}')" for m, terms, x in BOOSTS) + ") z GROUP BY 1, 2"
TOP_SQL = "WITH " + score_sql(L.METRIC_WEIGHTS, 5, 1, False) + f", bs AS ({BOOST_SQL}), tk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 6) DESC, metric_id DESC) AS rank FROM bs)"


def ranked(t, k):
    return L.ranked_texts(t.requests, "request_id", "nl_query", catalog_fields(t, L.METRIC_WEIGHTS), k, BOOSTS)


@query("lk_rank_topk", TOP_SQL + " SELECT request_id, metric_id, round(score, 6) AS score, rank FROM tk WHERE rank <= 3")
def _(t):
    return ranked(t, 3).withColumn("rank", F.col("rank").cast("bigint"))


PHRASES = [(m["metric_id"], p.lower()) for m in METRICS for p in dict.fromkeys([m["metric_name"], m["metric_id"].replace("_", " "), *m["aliases"]])]
PHRASE_V = values([(t, p, len(p)) for t, p in PHRASES], ["metric_id", "p", "n"])
NORMED = "SELECT request_id, trim(regexp_replace(lower(nl_query), '\\s+', ' ', 'g')) AS q FROM @requests r0"


@query("lk_longest_alias", f"""SELECT request_id, coalesce(metric_id, '') AS metric_id FROM ({NORMED}) r LEFT JOIN (SELECT request_id, metric_id, row_number() OVER (PARTITION BY request_id ORDER BY n DESC, metric_id) AS rn FROM ({NORMED}) r2 JOIN ({PHRASE_V}) v
 ON CASE WHEN regexp_full_match(p, '[a-z0-9_ ]+') THEN regexp_matches(q, '(^|[^a-z0-9_])' || p || '([^a-z0-9_]|$)') ELSE contains(q, p) END) z USING (request_id) WHERE coalesce(rn, 1) = 1""")
def _(t):
    return t.requests.select("request_id", L.longest_alias(X.normalize(F.col("nl_query")), PHRASES).alias("metric_id"))


@query("lk_first_mention", f"""SELECT request_id, coalesce(metric_id, '') AS metric_id FROM ({NORMED}) r LEFT JOIN (SELECT request_id, metric_id, row_number() OVER (PARTITION BY request_id ORDER BY strpos(q, p), n DESC, metric_id) AS rn FROM ({NORMED}) r2 JOIN ({PHRASE_V}) v
 ON contains(q, p)) z USING (request_id) WHERE coalesce(rn, 1) = 1""")
def _(t):
    return t.requests.select("request_id", L.first_mention(X.normalize(F.col("nl_query")), PHRASES).alias("metric_id"))


FUZZY_ALIASES = values([("m", m["metric_id"], a) for m in METRICS for a in m["aliases"]] + [("d", d["dimension_id"], a) for d in DIMENSIONS for a in d["aliases"]], ["kind", "id", "alias"])
PLAIN = lambda e: f"trim(lower(regexp_replace({e}, '[^\\p{{L}}\\p{{N}}_]', ' ', 'g')))"
WORD_SET = lambda e: f"list_sort(list_distinct(list_filter(string_split(regexp_replace({PLAIN(e)}, '\\s+', ' ', 'g'), ' '), lambda x: x <> '')))"
# The longest common subsequence by bits: a row of ones loses a bit per letter that is matched.
def fuzzy_sql(aliases):
    return f"""WITH n AS (SELECT request_id, replace(nl_query, 'ue', 'eu') AS q FROM @requests r), u AS (SELECT DISTINCT q, {WORD_SET('q')} AS w FROM n), al AS (SELECT kind, id, {WORD_SET('alias')} AS a, len({PLAIN('alias')}) AS size FROM ({aliases}) v),
 p AS (SELECT q, kind, id, size, len(w) = 0 OR len(a) = 0 AS nothing, array_to_string(list_filter(w, lambda x: list_contains(a, x)), ' ') AS b, array_to_string(list_filter(w, lambda x: NOT list_contains(a, x)), ' ') AS l,
  array_to_string(list_filter(a, lambda x: NOT list_contains(w, x)), ' ') AS r FROM u CROSS JOIN al),
 m AS (SELECT *, (1::HUGEINT << len(r)) - 1 AS ones, list_transform(string_split(l, ''), lambda c: coalesce(list_sum(list_transform(range(0, len(r)), lambda i: CASE WHEN r[i + 1] = c THEN 1::HUGEINT << i ELSE 0::HUGEINT END)), 0)::HUGEINT) AS masks FROM p),
 c AS (SELECT *, CASE WHEN l = '' OR r = '' THEN 0 ELSE len(r) - bit_count(list_reduce(list_prepend(ones, masks), lambda v, k: ((v + (v & k)) | (v - (v & k))) & ones)) END AS common, len(b) AS base, CASE WHEN b = '' THEN 0 ELSE 1 END AS gap FROM m),
 s AS (SELECT *, 100 * (1 - (len(l) + len(r) - 2 * common) / (2 * (base + gap) + len(l) + len(r))::DOUBLE) AS whole FROM c),
 f AS (SELECT q, kind, id, size, CASE WHEN nothing THEN 0 WHEN base > 0 AND (l = '' OR r = '') THEN 100 WHEN base = 0 THEN whole
  ELSE greatest(whole, 100 * (1 - (gap + len(l)) / (base + base + gap + len(l))::DOUBLE), 100 * (1 - (gap + len(r)) / (base + base + gap + len(r))::DOUBLE)) END AS score FROM s),
 top AS (SELECT q, id, score FROM f WHERE kind = 'm' QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, size DESC, id) = 1),
 d AS (SELECT q, string_agg(DISTINCT id, '|' ORDER BY id) AS dims FROM f WHERE kind = 'd' AND score >= 85 GROUP BY 1)
 SELECT request_id, CASE WHEN score >= 60 THEN id ELSE '' END AS metric_id, round(score, 6) AS score, coalesce(dims, '') AS dims FROM n JOIN top USING (q) LEFT JOIN d USING (q)"""


@query("lk_fuzzy_alias", fuzzy_sql(FUZZY_ALIASES))
def _(t):
    noisy = t.requests.select("request_id", F.regexp_replace("nl_query", "ue", "eu").alias("q"))
    links = L.fuzzy_links(scale.spread(noisy, "q"), "q", t.sql(FUZZY_ALIASES))
    return noisy.join(links, "q").select("request_id", "metric_id", F.round("score", 6).alias("score"), J("dimensions").alias("dims"))


# Every alias of every metric said of every nation and region, beside the plain ones.
WIDE_ALIASES = f"""SELECT kind, id, alias FROM ({FUZZY_ALIASES}) v UNION ALL SELECT kind, concat(id, ':', place), concat(alias, ' in ', lower(place)) FROM ({FUZZY_ALIASES}) w
 CROSS JOIN (SELECT n_name AS place FROM @nation UNION ALL SELECT r_name FROM @region) p WHERE kind = 'm'"""


@query("lk_fuzzy_alias_wide", fuzzy_sql(WIDE_ALIASES))
def _(t):
    noisy = t.requests.select("request_id", F.regexp_replace("nl_query", "ue", "eu").alias("q"))
    links = L.fuzzy_links(scale.spread(noisy, "q"), "q", t.sql(WIDE_ALIASES))
    return noisy.join(links, "q").select("request_id", "metric_id", F.round("score", 6).alias("score"), J("dimensions").alias("dims"))


# Dimension phrases of a rule list, and the coarser ones a finer one replaces.
RULES = [("month", ["monthly", "month", "月"]), ("quarter", ["quarter", "季度"]), ("region", ["region", "地区"]), ("nation", ["country", "nation", "国家"]), ("customer", ["customer", "客户"]), ("brand", ["brand"]), ("segment", ["segment"])]
COLLAPSE = [("customer", ["nation", "region"]), ("nation", ["region"]), ("month", ["quarter"])]
SCOPE = "CASE WHEN contains(q, ' by ') THEN substr(q, strpos(q, ' by ') + 4) WHEN contains(q, ' each ') THEN substr(q, strpos(q, ' each ') + 6) WHEN contains(q, '按') THEN substr(q, strpos(q, '按') + 1) WHEN contains(q, 'monthly') THEN 'month' WHEN contains(q, 'quarterly') THEN 'quarter' ELSE '' END"
RULE_SQL = f"""ex AS (SELECT request_id, {', '.join(f"regexp_matches(s, '{'|'.join(p)}') AS {d}_" for d, p in RULES)} FROM (SELECT request_id, {SCOPE} AS s FROM ({NORMED}) r) z),
 ed AS (SELECT request_id, concat_ws('|', CASE WHEN month_ THEN 'month' END, CASE WHEN quarter_ AND NOT month_ THEN 'quarter' END, CASE WHEN region_ AND NOT customer_ AND NOT nation_ THEN 'region' END, CASE WHEN nation_ AND NOT customer_ THEN 'nation' END,
  CASE WHEN customer_ THEN 'customer' END, CASE WHEN brand_ THEN 'brand' END, CASE WHEN segment_ THEN 'segment' END) AS dims FROM ex)"""


def explicit(t):
    s = t.requests.withColumn("_s", L.cue_scope(X.normalize(F.col("nl_query")), (" by ", " each ", "按")))
    return s.select("request_id", L.explicit_dimensions(F.col("_s"), RULES, COLLAPSE).alias("dims"))


@query("lk_explicit_dims", f"WITH {RULE_SQL} SELECT request_id, dims FROM ed")
def _(t):
    return explicit(t).select("request_id", J("dims").alias("dims"))


COLS = [("r_name", "region", "region"), ("n_name", "country", "nation"), ("p_brand", "brand", "part"), ("c_mktsegment", "market segment", "customer"), ("o_orderpriority", "priority", "orders"), ("o_orderdate", "month", "orders")]
COL_FIELDS = values([(c, f, w) for c, n, tb in COLS for f, w in ((n, 3.0), (c, 2.0), (tb, 1.0))], ["col", "field", "w"])


@query("lk_group_cue_dims", f"""WITH u AS (SELECT request_id, lower(trim(nl_query)) AS q, {TOKENS('lower(trim(nl_query))')} AS qt FROM @requests r0 WHERE regexp_matches(' ' || lower(nl_query) || ' ', ' by | per | each |group|distribution|breakdown|ranked by|monthly|yearly')),
 s AS (SELECT request_id, col, sum(5 * CAST(w AS DOUBLE) * contains(q, field)::INT + CAST(w AS DOUBLE) * len(list_intersect(qt, {TOKENS('field')}))) AS score FROM u JOIN ({COL_FIELDS}) f ON true GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, col DESC) AS rn FROM s WHERE score > 0) SELECT request_id, col FROM k WHERE rn <= 2 AND NOT (col = 'p_brand' AND request_id % 2 = 0)""")
def _(t):
    schema = T.StructType([T.StructField("column", T.StringType()), T.StructField("field", T.StringType()), T.StructField("weight", T.DoubleType())])
    cols = rows_of(t.spark, [dict(column=c, field=f, weight=w) for c, n, tb in COLS for f, w in ((n, 3.0), (c, 2.0), (tb, 1.0))], schema)
    allowed = t.requests.select("request_id", F.explode(X.lit_list([c for c, _, _ in COLS])).alias("column")).filter("NOT (column = 'p_brand' AND request_id % 2 = 0)")
    return L.group_cue_dimensions(t.spread("requests"), "request_id", "nl_query", cols, 2, allowed).select("request_id", F.col("column").alias("col"))


MODES = ["direct", "schema", "guarded", "oracle", "compiled"]
REFUSE = "regexp_matches(lower(nl_query), 'select |drop |delete |email|phone|weather|tomorrow')"


@query("lk_mode_predict", DEC.replace("WITH ", "WITH " + score_sql(L.METRIC_WEIGHTS, 5, 1, False) + "," + score_sql(L.DIRECT_WEIGHTS, 5, 1, False, "sd").replace("u AS", "u2 AS").replace("fv AS", "fv2 AS").replace("uq AS", "uq2 AS").replace("FROM u JOIN fv", "FROM u2 JOIN fv2").replace("JOIN uq ON uq.q", "JOIN uq2 ON uq2.q") +
 ", t1 AS (SELECT request_id, arg_max(metric_id, (score, metric_id)) AS m FROM sc GROUP BY 1), t2 AS (SELECT request_id, arg_max(metric_id, (score, metric_id)) AS m FROM sd GROUP BY 1), " + RULE_SQL + ", ", 1).replace(
 "SELECT request_id, nl_query, CASE WHEN request_id % 31 = 7 THEN 'ghost' ELSE g_metric END AS metric_id FROM", "SELECT r0.request_id, nl_query, coalesce(t1.m, '') AS metric_id FROM").replace(" r0) r1)", " r0 LEFT JOIN t1 USING (request_id)) r1)") +
 f""", md AS (SELECT request_id, unnest(['direct', 'schema', 'guarded', 'oracle', 'compiled']) AS mode, {REFUSE} AS ref, nl_query FROM r),
 j AS (SELECT md.*, t2.m AS dm, t1.m AS fm, g_metric, ed.dims, chk.resolved, {sql_failed()} AS f FROM md JOIN @requests rq USING (request_id) LEFT JOIN t1 USING (request_id) LEFT JOIN t2 USING (request_id) JOIN ed USING (request_id) JOIN chk USING (request_id))
 SELECT mode, request_id, CASE WHEN (mode IN ('guarded', 'oracle') AND ref) OR (mode = 'compiled' AND f <> '') THEN 'refuse' ELSE 'answer' END AS action,
 CASE WHEN (mode IN ('guarded', 'oracle') AND ref) OR (mode = 'compiled' AND f <> '') THEN '' WHEN mode = 'direct' THEN coalesce(dm, '') WHEN mode = 'oracle' THEN g_metric ELSE coalesce(fm, '') END AS metric,
 CASE WHEN (mode IN ('guarded', 'oracle') AND ref) OR (mode = 'compiled' AND f <> '') OR mode = 'direct' THEN '' WHEN mode = 'compiled' THEN resolved ELSE dims END AS dims FROM j""")
def _(t):
    r = t.requests.select("request_id", "nl_query", "g_metric").withColumn("_u", F.lower(F.trim("nl_query")))
    texts = r.select("_u").filter("_u IS NOT NULL").distinct()
    best = lambda weights, n: L.text_best(texts, "_u", "_u", catalog_fields(t, weights)).withColumnRenamed("metric_id", n)
    linked = best(L.METRIC_WEIGHTS, "metric_id").join(best(L.DIRECT_WEIGHTS, "direct_id"), "_u", "full")
    r = r.join(explicit(t), "request_id").join(linked, "_u", "left").drop("_u")
    r = r.withColumn("metric_id", F.coalesce("metric_id", F.lit("")))
    d = C.compile_requests(r, C.contract_of(t.spark, CAT), CAT)
    refuse = F.lower("nl_query").rlike("select |drop |delete |email|phone|weather|tomorrow")
    e = d.withColumn("mode", F.explode(X.lit_list(MODES))).withColumn("_no", F.col("mode").isin("guarded", "oracle") & refuse | (F.col("mode") == "compiled") & (F.col("decision.action") == "refuse"))
    mode, no = F.col("mode"), F.col("_no")
    return e.select(
        "mode", "request_id", F.when(no, "refuse").otherwise("answer").alias("action"),
        F.when(no, "").when(mode == "direct", F.coalesce("direct_id", F.lit(""))).when(mode == "oracle", F.col("g_metric")).otherwise(F.col("metric_id")).alias("metric"),
        F.when(no | (mode == "direct"), "").when(mode == "compiled", J("decision.pred_dimensions")).otherwise(J("dims")).alias("dims"))


CENTER = "SELECT label AS query_id, list(m ORDER BY pos) AS vector FROM (SELECT label, pos, round(avg(v), 6) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1"
NEAR = f"nr AS (SELECT query_id, vec_id, round(list_distance(embedding::DOUBLE[], vector), 6) AS distance FROM embeddings JOIN ({CENTER}) c ON true), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM nr)"


def centers(t):
    v = t.embeddings.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v")).groupBy("label", "pos").agg(F.round(F.avg("v"), 6).alias("m"))
    return v.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("vector"))


@query("lk_vector_topk", f"WITH {NEAR} SELECT query_id, vec_id, distance, rank FROM rk WHERE rank <= 5")
def _(t):
    return L.vector_topk(t.embeddings, "vec_id", "embedding", centers(t), 5).withColumn("rank", F.col("rank").cast("bigint"))


@query("lk_vector_next_page", f"""WITH {NEAR} SELECT query_id, vec_id, distance, rank - 3 AS rank, NULL::BIGINT AS used_count, NULL::BIGINT AS remaining, NULL::BOOLEAN AS is_complete FROM rk WHERE rank BETWEEN 4 AND 8
 UNION ALL SELECT query_id, NULL, NULL, NULL, least(count(*), 8), count(*) - least(count(*), 8), count(*) <= 8 FROM rk GROUP BY 1""")
def _(t):
    q = centers(t)
    used = L.vector_topk(t.embeddings, "vec_id", "embedding", q, 3).select("query_id", "vec_id")
    page = L.vector_next_page(t.embeddings, "vec_id", "embedding", q, used, 3, 5).withColumn("rank", F.col("rank").cast("bigint"))
    return page.unionByName(L.page_status(page, used, t.embeddings.agg(F.count(F.lit(1)).alias("total")), 5), allowMissingColumns=True)


# Every vector asks for its neighbours.
MANY = "nr AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings e, embeddings q), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM nr)"


@query("lk_vector_many", f"WITH {MANY} SELECT query_id, vec_id, distance, rank FROM rk WHERE rank <= 5")
def _(t):
    asked = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return L.vector_topk(t.embeddings, "vec_id", "embedding", asked, 5).withColumn("rank", F.col("rank").cast("bigint"))


@query("lk_candidate_recall", TOP_SQL + f""", {RULE_SQL}, h AS (SELECT g.request_id, count(*) FILTER (tk.metric_id = g.expected_metric_id) > 0 AS mh FROM @gold g LEFT JOIN tk ON tk.request_id = g.request_id AND rank <= 3 WHERE expected_action = 'answer' GROUP BY 1),
 x AS (SELECT mh, expected_dims = '' OR list_has_all(string_split(ed.dims, '|'), string_split(expected_dims, '|')) AS dh FROM h JOIN @gold g USING (request_id) JOIN ed USING (request_id))
 SELECT count(*) AS n, round(avg(mh::INT), 6) AS metric_recall, round(avg(dh::INT), 6) AS dim_recall, round(avg((mh AND dh)::INT), 6) AS joint_recall FROM x""")
def _(t):
    g = t.gold.filter("expected_action = 'answer'")
    found = ranked(t, 3).select("request_id", F.col("metric_id").alias("expected_metric_id"), F.lit(True).alias("mh"))
    x = g.join(found, ["request_id", "expected_metric_id"], "left").join(explicit(t), "request_id")
    mh, dh = F.coalesce("mh", F.lit(False)), F.size(F.array_except(LIST("expected_dims"), "dims")) == 0
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return x.agg(F.count(F.lit(1)).alias("n"), rate(mh).alias("metric_recall"), rate(dh).alias("dim_recall"), rate(mh & dh).alias("joint_recall"))


@query("lk_catalog_scale", "WITH " + score_sql(L.PANEL_WEIGHTS, 5, 1, False, metrics=with_copies()) + " SELECT request_id, arg_max(metric_id, (score, metric_id)) AS metric_id FROM sc GROUP BY 1")
def _(t):
    fields = L.field_rows(rows_of(t.spark, with_copies(), METRIC_SCHEMA), L.PANEL_WEIGHTS)
    return L.ranked_texts(t.requests, "request_id", "nl_query", fields, 1).select("request_id", "metric_id")
