"""Filters and predicates."""

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import filters as P
from plumbline.plans.governed import POLICIES
from plumbline.queries import query

CASES = "SELECT case_id, nl_query, query_family, expected_action, expected_metric_id, expected_dims FROM @labelled l"
LIST = lambda c: F.filter(F.split(c, r"\|"), lambda d: d != "")


@query("flt_blind_gold_split", f"""SELECT 'blind' AS side, case_id, nl_query AS a, query_family AS b, NULL AS c, NULL AS d FROM ({CASES}) x
 UNION ALL SELECT 'gold', case_id, expected_action, query_family, expected_metric_id, expected_dims FROM ({CASES}) y""")
def _(t):
    cases = t.sql(CASES)
    b, g = P.blind(cases), P.gold(cases)
    assert not P.leaked_columns(b)
    none = F.lit(None).cast("string")
    return b.select(F.lit("blind").alias("side"), "case_id", F.col("nl_query").alias("a"), F.col("query_family").alias("b"), none.alias("c"), none.alias("d")).union(
        g.select(F.lit("gold"), "case_id", "expected_action", "query_family", "expected_metric_id", "expected_dims"))


PAYLOAD = """SELECT request_id, concat('{"case_id": "', case_id, '", "nl_query": "q"', CASE WHEN tpl = 3 THEN ', "expected_action": "answer"' WHEN tpl = 5 THEN ', "prompt_digest": "x", "expected_b": 1' WHEN tpl = 7 THEN ', "severity": "low"' ELSE '' END,
 CASE WHEN tpl = 8 THEN ', "format": "v1"}' ELSE ', "format": "v2"}' END) AS doc, tpl FROM @requests r"""


@query("flt_leak_audit", f"""SELECT request_id, CASE tpl WHEN 3 THEN 'expected_action' ELSE 'expected_b,prompt_digest' END AS leaked FROM ({PAYLOAD}) p WHERE tpl IN (3, 5)""")
def _(t):
    leaks = P.leaked_keys(F.col("doc"), ["prompt_digest"])
    return t.sql(PAYLOAD).select("request_id", F.array_join(leaks, ",").alias("leaked")).filter("leaked <> ''")


@query("flt_allowlist_schema", f"""SELECT request_id, CASE tpl WHEN 3 THEN 'expected_action' WHEN 5 THEN 'expected_b,prompt_digest' ELSE '' END AS extra, tpl = 8 AS bad_format FROM ({PAYLOAD}) p WHERE tpl IN (3, 5, 8)""")
def _(t):
    d = t.sql(PAYLOAD).select("request_id", F.array_join(P.unexpected_keys(F.col("doc"), ["case_id", "nl_query", "severity", "format"]), ",").alias("extra"),
                              (F.get_json_object("doc", "$.format") != "v2").alias("bad_format"))
    return d.filter("extra <> '' OR bad_format")


@query("flt_required_fields", """SELECT doc_id FROM documents WHERE length(text) > 0 AND length(lang) > 0 AND length(source) > 0 AND doc_id % 3 <> 0""")
def _(t):
    d = t.documents.withColumn("steps", F.split("text", "\n")).withColumn(
        "cot", F.array(F.lit("a"), F.when(F.col("doc_id") % 3 != 0, F.lit("b"))))
    return P.required_fields(d, ["text", "lang", "source"], ["steps", "cot"], last_of="cot").select("doc_id")


@query("flt_substring_trigger", """SELECT request_id, policy_id, trig FROM (SELECT request_id, trim(regexp_replace(lower(nl_query), '\\s+', ' ', 'g')) AS q FROM @requests r)
 JOIN (VALUES ('sql_or_ddl','select '),('sql_or_ddl','drop '),('sql_or_ddl','delete '),('sql_or_ddl','insert '),('sql_or_ddl','update '),('sql_or_ddl','truncate '),
 ('sensitive','phone list'),('sensitive','email'),('sensitive','phone'),('sensitive','personal contact'),('sensitive','customer identifier'),('off_domain','weather'),('off_domain','tomorrow')) v(policy_id, trig) ON contains(q, trig)""")
def _(t):
    hits = P.substring_hits(X.normalize(F.col("nl_query")), P.trigger_rows(POLICIES, strip=False))
    return t.requests.select("request_id", F.explode(hits).alias("h")).select("request_id", "h.policy_id", F.col("h.trigger").alias("trig"))


@query("flt_exact_trigger", """SELECT request_id, 'sensitive' AS policy_id FROM @requests r WHERE lower(nl_query) = 'show me the numbers'""")
def _(t):
    phrases = t.spark.createDataFrame([(p["policy_id"], a) for p in POLICIES for a in p["ambiguous_queries"]], "policy_id string, phrase string")
    return P.exact_trigger(t.requests, "nl_query", phrases).select("request_id", "policy_id")


POLICY_TEXT = """SELECT p_partkey, concat(p_name, CASE p_partkey % 5 WHEN 0 THEN ' raw SQL text' WHEN 1 THEN ' Personal data' WHEN 2 THEN ' off-domain and DDL' WHEN 3 THEN ' Unsupported identifier' ELSE '' END) AS trig FROM @part"""


@query("flt_trigger_expand", f"""SELECT p_partkey, term FROM ({POLICY_TEXT}) p JOIN (VALUES ('sql|ddl','select '),('sql|ddl','drop '),('sql|ddl','delete '),('sql|ddl','insert '),('sql|ddl','update '),('sql|ddl','truncate '),
 ('personal|customer|identifier','email'),('personal|customer|identifier','phone'),('personal|customer|identifier','personal contact'),('personal|customer|identifier','customer identifier'),
 ('off-domain','weather'),('off-domain','tomorrow'),('unsupported','unsupported'),('unsupported','experimental margin')) v(rx, term) ON regexp_matches(lower(trig), rx)""")
def _(t):
    return t.sql(POLICY_TEXT).select("p_partkey", F.explode(P.expanded_terms(F.col("trig"))).alias("term"))


@query("flt_refusal_category", """SELECT request_id, CASE WHEN expected_action <> 'refuse' THEN 'answerable' WHEN regexp_matches(q, 'select |drop |delete |insert |update ') THEN 'sql_or_ddl'
 WHEN regexp_matches(q, 'email|phone|personal contact|identifier|customer') THEN 'sensitive_or_identifier' WHEN regexp_matches(q, 'weather|tomorrow') THEN 'off_domain'
 WHEN regexp_matches(q, 'unsupported|experimental margin') THEN 'unsupported_metric' ELSE 'policy_denied' END AS category FROM (SELECT *, lower(nl_query) AS q FROM @labelled l)""")
def _(t):
    return t.labelled.select("request_id", P.refusal_category(F.col("nl_query"), F.col("expected_action")).alias("category"))


@query("flt_query_family", """SELECT request_id, CASE WHEN expected_action = 'refuse' THEN 'policy_refusal' WHEN request_id % 9 = 0 THEN 'ranking_topk'
 WHEN expected_dims LIKE '%|%' THEN 'multi_dimension' WHEN expected_dims <> '' THEN 'single_dimension' ELSE 'flat_metric' END AS family FROM @labelled l""")
def _(t):
    q = F.concat("nl_query", F.when(F.col("request_id") % 9 == 0, " Top 10").otherwise(""))
    return t.labelled.select("request_id", P.query_family(q, F.col("expected_action"), LIST("expected_dims")).alias("family"))


COLUMNS = """SELECT p_partkey, concat(p_brand, '.', p_type) AS tbl, concat(CASE p_size % 4 WHEN 0 THEN 'Id_' WHEN 1 THEN 'fullName' WHEN 2 THEN 'zip_code' ELSE 'amount' END, CAST(p_partkey AS STRING)) AS col FROM @part"""


@query("flt_key_like_columns", f"""SELECT tbl, col FROM ({COLUMNS}) c WHERE regexp_matches(lower(col), 'id|name|code') AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49)""")
def _(t):
    used = t.lineitem.filter("l_returnflag = 'R' AND l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return P.key_like_columns(t.sql(COLUMNS).withColumnRenamed("col", "column"), used, "p_partkey").select("tbl", F.col("column").alias("col"))


@query("flt_foreign_key_consistent", """SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = o_orderkey % 25""")
def _(t):
    items = t.orders.select("o_orderkey", F.col("o_custkey").alias("item_id"), (F.col("o_orderkey") % 25).cast("int").alias("db_id"))
    ref = t.customer.select(F.col("c_custkey").alias("item_id"), F.col("c_nationkey").alias("db_id"))
    return P.consistent(items, ref, ["item_id", "db_id"]).select("o_orderkey")


@query("flt_label_agrees", """SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE (CASE WHEN doc_id % 4 = 0 THEN 'unsafe' ELSE 'safe' END) = (CASE WHEN toxic = 1 THEN 'unsafe' ELSE 'safe' END)""")
def _(t):
    d = t.documents.join(t.labels, "doc_id").withColumn(
        "cot", F.concat(F.lit("<secureCOT>x</secureCOT><secure_output>"), F.when(F.col("doc_id") % 4 == 0, "unsafe").otherwise("safe"), F.lit("</secure_output>")))
    return d.filter(X.tag_text(F.col("cot"), "secure_output") == F.when(F.col("toxic") == 1, "unsafe").otherwise("safe")).select("doc_id")


MENTIONS = """SELECT o_orderkey, c_nationkey AS db, concat('SELECT ', CASE o_orderkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN o_orderpriority ELSE 'x' END, ' FROM orders') AS sql FROM @orders JOIN @customer ON o_custkey = c_custkey"""


@query("flt_sensitive_mention", f"""SELECT o_orderkey FROM ({MENTIONS}) m JOIN nation ON db = n_nationkey WHERE NOT contains(sql, CASE WHEN n_regionkey = 1 THEN 'BUILDING' ELSE '1-URGENT' END) AND NOT contains(sql, 'MACHINERY')""")
def _(t):
    protected = t.nation.select(F.col("n_nationkey").alias("db"), F.array(F.when(F.col("n_regionkey") == 1, "BUILDING").otherwise("1-URGENT"), F.lit("MACHINERY")).alias("columns"))
    return P.sensitive_mention(t.sql(MENTIONS), protected, "db").select("o_orderkey")


WITHS = """SELECT request_id, CASE WHEN tpl = 2 THEN concat('With a AS (', nl_query, ') select 1') WHEN tpl = 3 THEN concat('  select', chr(10), ' withdrawn  FROM ', nl_query, ' ') ELSE nl_query END AS q FROM @requests r"""


@query("flt_sql_keyword_clean", f"""SELECT request_id, trim(regexp_replace(q, '\\s+', ' ', 'g')) AS q FROM ({WITHS}) w WHERE NOT regexp_matches(q, '(?i)\\bwith\\b')""")
def _(t):
    return P.keyword_clean(t.sql(WITHS), "q")


@query("flt_columns_mentioned", """SELECT request_id FROM @requests r WHERE contains(nl_query, split_part(d1, '_', 1))""")
def _(t):
    listing = F.concat(F.lit("["), F.split_part(F.col("d1"), F.lit("_"), F.lit(1)), F.lit(" (text), (none) ]"))
    return t.requests.filter(P.columns_mentioned(listing, F.col("nl_query"))).select("request_id")


@query("flt_time_range", """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'""")
def _(t):
    d = t.lineitem.filter((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")))
    return d.select("l_orderkey", "l_linenumber", "l_partkey")


@query("flt_scope_value_in_column", """SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND abs(l.l_quantity - (o.o_orderkey % 50 + 0.0000004)) < 1e-6)
 OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND o.o_orderkey % 50 = 0 AND l.l_returnflag = 'A')""")
def _(t):
    k = F.col("o_orderkey")
    want = t.orders.select(k.alias("k"), F.explode(F.array((k % 50 + F.lit(0.0000004)).cast("string"), F.when(k % 50 == 0, F.lit("A")))).alias("value")).filter("value is not null")
    have = t.lineitem.select(F.col("l_orderkey").alias("k"), F.explode(F.array(F.col("l_quantity").cast("string"), "l_returnflag")).alias("cell"))
    return P.value_in_column(want, have, ["k"]).select(F.col("k").alias("o_orderkey")).distinct()
