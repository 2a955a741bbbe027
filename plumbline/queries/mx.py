"""Governed metric execution on the star schema."""

from itertools import combinations

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import contract as C, metrics as M, scale
from plumbline.plans import execute as E
from plumbline.plans.governed import DIMENSIONS, METRICS, catalog
from plumbline.queries import query
from plumbline.session import checkpointed
from plumbline.queries.ct import CAT, METRIC_V, decided, sql_decisions, sql_failed

DIMS = {d["dimension_id"]: d["sql"] for d in DIMENSIONS}
PARENTS = {d["dimension_id"]: d["parent"] for d in DIMENSIONS if d["parent"]}
R6 = lambda c: F.round(c, 6)

FACT = """(SELECT l.*, o.*, c_name, c_mktsegment, n_name, r_name, p_brand, p_type, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_return, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y-%m') AS month,
 strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS quarter FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""
SQL_DIM = {"region": "r_name", "nation": "n_name", "customer": "c_name", "year": "year", "quarter": "quarter", "month": "month", "brand": "p_brand", "part_type": "p_type", "segment": "c_mktsegment", "priority": "o_orderpriority"}
SQL_METRIC = {"revenue": "sum(l_extendedprice * (1 - l_discount))", "units": "sum(l_quantity)", "order_count": "count(DISTINCT o_orderkey)::DOUBLE", "customer_count": "count(DISTINCT o_custkey)::DOUBLE",
              "average_order_value": "sum(l_extendedprice * (1 - l_discount)) / count(DISTINCT o_orderkey)", "average_unit_price": "sum(l_extendedprice) / sum(l_quantity)",
              "return_share": "sum(l_quantity * is_return) / sum(l_quantity)", "discount_amount": "sum(l_extendedprice * l_discount)"}


def fact(t):
    return M.star(t.lineitem, t.orders, t.customer, t.nation, t.region, t.part)


@query("mx_simple_agg", """SELECT l_returnflag, round(sum(l_quantity), 6) AS sum, count(l_quantity) AS count, count(DISTINCT l_quantity) AS count_distinct, round(avg(l_quantity), 6) AS average, min(l_quantity) AS min, max(l_quantity) AS max,
 sum((l_linestatus = 'F')::INT)::BIGINT AS sum_boolean, round(median(l_extendedprice), 6) AS median, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1""")
def _(t):
    li = t.lineitem.withColumn("flag", F.col("l_linestatus") == "F")
    aggs = li.groupBy("l_returnflag").agg(*M.simple_aggregates("l_quantity", "flag"))
    ranks = M.percentiles(li, ["l_returnflag"], "l_extendedprice", {"median": 0.5, "p90": 0.9}, width=100.0)
    return aggs.join(ranks, "l_returnflag").select(
        "l_returnflag", R6("sum").alias("sum"), "count", "count_distinct", R6("average").alias("average"), "min", "max", "sum_boolean", R6("median").alias("median"), R6("p90").alias("p90"))


@query("mx_ratio", """SELECT p_brand, round(sum(l_extendedprice) / nullif(sum(CASE WHEN p_size > 25 THEN l_quantity ELSE 0 END), 0), 6) AS price_per_big_unit,
 round(sum(l_quantity * (l_returnflag = 'R')::INT) / nullif(sum(l_quantity), 0), 6) AS return_share FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def _(t):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    big = F.sum(F.when(F.col("p_size") > 25, F.col("l_quantity")).otherwise(0))
    ret = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0))
    return j.groupBy("p_brand").agg(R6(M.ratio(F.sum("l_extendedprice"), big)).alias("price_per_big_unit"), R6(M.ratio(ret, F.sum("l_quantity"))).alias("return_share"))


@query("mx_derived", """SELECT o_orderpriority, round(rev / nullif(n, 0), 6) AS aov, round((rev - gross) / nullif(gross, 0), 6) AS discount_rate FROM
 (SELECT o_orderpriority, sum(l_extendedprice * (1 - l_discount)) AS rev, sum(l_extendedprice) AS gross, count(DISTINCT o_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)""")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # one row per order first, so that the order count needs no distinct
    per = j.groupBy("o_orderkey", "o_orderpriority").agg(F.sum(F.expr("l_extendedprice * (1 - l_discount)")).alias("rev"), F.sum("l_extendedprice").alias("gross"))
    inputs = per.groupBy("o_orderpriority").agg(F.sum("rev").alias("rev"), F.sum("gross").alias("gross"), F.count(F.lit(1)).alias("n"))
    return inputs.select("o_orderpriority", R6(F.expr("rev / nullif(n, 0)")).alias("aov"), R6(F.expr("(rev - gross) / nullif(gross, 0)")).alias("discount_rate"))


@query("mx_plan_group", f"""SELECT nation, segment, round(metric_value, 4) AS metric_value FROM (SELECT n_name AS nation, c_mktsegment AS segment, {SQL_METRIC['average_order_value']} AS metric_value FROM {FACT} f GROUP BY 1, 2) ORDER BY metric_value DESC, nation, segment LIMIT 20""")
def _(t):
    dims = {d: DIMS[d] for d in ("nation", "segment")}
    value = F.sum(F.expr("l_extendedprice * (1 - l_discount)")) / F.count_distinct("o_orderkey")
    return M.plan_group(fact(t), dims, value).withColumn("metric_value", F.round("metric_value", 4))


SETS = [["region"], ["nation"], ["segment", "year"], ["brand"], ["month"], ["part_type", "region"], []]
SET_SQL = " UNION ALL ".join(
    f"SELECT '{'|'.join(sorted(s))}' AS dims, " + ("concat_ws('|', " + ", ".join(SQL_DIM[d] for d in sorted(s)) + ")" if s else "''") +
    f" AS key, round(sum(l_extendedprice * (1 - l_discount)), 4) AS rev, round(sum(l_quantity), 2) AS qty FROM f" + (" GROUP BY " + ", ".join(SQL_DIM[d] for d in s) if s else "") for s in SETS)


@query("mx_grouping_sets", f"WITH f AS (SELECT * FROM {FACT} f0) {SET_SQL}")
def _(t):
    g = M.grouping_sets(fact(t), DIMS, SETS, [("rev", F.expr("l_extendedprice * (1 - l_discount)")), ("qty", F.col("l_quantity"))], PARENTS)
    return g.select("dims", "key", F.round("rev", 4).alias("rev"), F.round("qty", 2).alias("qty"))


# All sets of at most four dimensions without the customer, and of at most two others with it: 302.
LATTICE = [list(s) for n in range(5) for s in combinations(sorted(d for d in DIMS if d != "customer"), n)]
LATTICE += [["customer", *s] for s in LATTICE if len(s) <= 2]
LATTICE_SQL = f"""SELECT concat_ws('|', {', '.join(f"CASE WHEN grouping({SQL_DIM[d]}) = 0 THEN '{d}' END" for d in sorted(SQL_DIM))}) AS dims, sum(l_extendedprice * (1 - l_discount)) AS rev, sum(l_quantity) AS qty
 FROM f GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(SQL_DIM[d] for d in s) + ')' for s in LATTICE)})"""


@query("mx_cuboid_lattice", f"WITH f AS (SELECT * FROM {FACT} f0), g AS ({LATTICE_SQL}) SELECT dims, count(*) AS cells, round(max(rev), 4) AS top_rev, round(sum(qty), 2) AS qty FROM g GROUP BY 1")
def _(t):
    g = M.grouping_sets(fact(t), DIMS, LATTICE, [("rev", F.expr("l_extendedprice * (1 - l_discount)")), ("qty", F.col("l_quantity"))], PARENTS)
    return g.groupBy("dims").agg(F.count(F.lit(1)).alias("cells"), F.round(F.max("rev"), 4).alias("top_rev"), F.round(F.sum("qty"), 2).alias("qty"))


def accepted(t):
    d = decided(t).filter("decision.action = 'answer'")
    return d.groupBy(F.col("decision.pred_metric_id").alias("metric"), F.array_join(F.sort_array("decision.pred_dimensions"), "|").alias("dims")).agg(F.count(F.lit(1)).alias("requests"))


ONE_SUM = """sum(CASE metric WHEN 'revenue' THEN l_extendedprice * (1 - l_discount) WHEN 'average_order_value' THEN l_extendedprice * (1 - l_discount) WHEN 'units' THEN l_quantity
 WHEN 'average_unit_price' THEN l_extendedprice WHEN 'return_share' THEN l_quantity * is_return WHEN 'discount_amount' THEN l_extendedprice * l_discount END)"""
ONE_COUNT = "count(DISTINCT CASE WHEN metric = 'customer_count' THEN o_custkey WHEN metric IN ('order_count', 'average_order_value') THEN o_orderkey END)"


def plan_sql():
    """Each accepted (metric, dims) plan on its own rows of the fact, grouped by the values its dimensions take."""
    keyed = ", ".join(f"CASE WHEN list_contains(string_split(dims, '|'), '{d}') THEN {SQL_DIM[d]} END" for d in sorted(SQL_DIM))
    return f"""SELECT metric, dims, CASE WHEN metric IN ('order_count', 'customer_count') THEN n WHEN metric = 'average_order_value' THEN s / n WHEN metric IN ('average_unit_price', 'return_share') THEN s / q ELSE s END AS value
 FROM (SELECT metric, dims, concat_ws('|', {keyed}) AS key, {ONE_SUM} AS s, {ONE_COUNT}::DOUBLE AS n, sum(l_quantity) AS q FROM p JOIN f ON true GROUP BY 1, 2, 3) k"""


@query("mx_plan_execute_log", "WITH " + sql_decisions() + f""", p AS (SELECT metric_id AS metric, resolved_s AS dims, count(*) AS requests FROM (SELECT *, array_to_string(list_sort(string_split(resolved, '|')), '|') AS resolved_s, {sql_failed()} AS f FROM chk) z WHERE f = '' GROUP BY 1, 2),
 f AS (SELECT * FROM {FACT} f0), v AS ({plan_sql()}) SELECT metric, dims, any_value(requests) AS requests, true AS execute_ok, count(*) AS row_count, round(max(value), 4) AS top_value FROM v JOIN p USING (metric, dims) GROUP BY 1, 2""")
def _(t):
    plans = checkpointed(accepted(t))
    values = E.values_of(plans, fact(t), DIMS, PARENTS)
    log = E.execution_log(plans, values)
    return log.select("metric", "dims", "requests", "execute_ok", "row_count", F.round("top_value", 4).alias("top_value"))


@query("mx_dim_expr", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS quarter, strftime(o_orderdate, '%Y') AS year, o_orderpriority AS priority FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", *[F.expr(DIMS[d]).alias(d) for d in ("month", "quarter", "year", "priority")])


LEAST = "CASE event_type WHEN 'click' THEN 'hour' WHEN 'view' THEN 'day' WHEN 'error' THEN 'week' WHEN 'purchase' THEN 'month' ELSE 'quarter' END"


@query("mx_time_grain_ladder", f"""SELECT event_type, grain, strftime(date_trunc(grain, ts), '%Y-%m-%d %H:%M:%S') AS period, count(*) AS n,
 CASE grain WHEN 'hour' THEN 'day' WHEN 'day' THEN 'month' WHEN 'month' THEN 'quarter' WHEN 'quarter' THEN 'year' ELSE '' END AS parent
 FROM (SELECT *, unnest(['hour', 'day', 'week', 'month', 'quarter', 'year'][list_position(['hour', 'day', 'week', 'month', 'quarter', 'year'], {LEAST}):]) AS grain FROM events) e GROUP BY ALL""")
def _(t):
    g = M.by_grain(t.events, "ts", F.expr(LEAST), ["event_type"])
    return g.select("event_type", "grain", F.date_format("period", "yyyy-MM-dd HH:mm:ss").alias("period"), "n", "parent")


@query("mx_time_spine", """WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS v FROM events GROUP BY ALL), s AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY 1)
 SELECT user_id, day::VARCHAR AS day, coalesce(v, 0) AS value FROM s LEFT JOIN d USING (user_id, day)""")
def _(t):
    return M.on_spine(t.events, "ts", ["user_id"], F.count(F.lit(1))).withColumn("day", F.col("day").cast("string"))


@query("mx_metric_filter", """SELECT l_shipdate::DATE::VARCHAR AS day, round(sum(l_extendedprice) FILTER (l_returnflag = 'R' AND l_quantity > 10), 4) AS returned, count(*) FILTER (l_discount > 0.05) AS deep FROM lineitem GROUP BY 1""")
def _(t):
    return t.lineitem.groupBy(F.to_date("l_shipdate").cast("string").alias("day")).agg(
        F.round(F.sum(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 10), F.col("l_extendedprice"))), 4).alias("returned"),
        F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("deep"))


@query("mx_period_compare", """WITH m AS (SELECT o_orderpriority, date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice), 4) AS value FROM orders GROUP BY ALL)
 SELECT a.o_orderpriority, a.month::VARCHAR AS month, a.value, b.value AS previous FROM m a LEFT JOIN m b ON a.o_orderpriority = b.o_orderpriority AND a.month = b.month + INTERVAL 12 MONTH""")
def _(t):
    s = t.orders.groupBy("o_orderpriority", F.trunc("o_orderdate", "month").alias("month")).agg(F.round(F.sum("o_totalprice"), 4).alias("value"))
    return M.period_compare(s, "month", ["o_orderpriority"], "value").withColumn("month", F.col("month").cast("string"))


KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


@query("mx_surrogate_key", f"SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY {', '.join(KEY)}) AS sale_line_id FROM lineitem")
def _(t):
    li = t.lineitem.select(*KEY)
    return scale.positions(li, KEY, scale.key_buckets("l_orderkey"), name="sale_line_id").select("l_orderkey", "l_linenumber", "l_partkey", "sale_line_id")


@query("mx_data_parity", """SELECT unnest(['row_count', 'sum_price', 'sum_quantity', 'sum_discount', 'distinct_orders', 'distinct_parts', 'distinct_suppliers', 'min_ship', 'max_ship']) AS check, true AS match, unnest([
 count(*)::VARCHAR, round(sum(l_extendedprice), 2)::DECIMAL(18, 2)::VARCHAR, round(sum(l_quantity), 2)::DECIMAL(18, 2)::VARCHAR, round(sum(l_discount), 2)::DECIMAL(18, 2)::VARCHAR, count(DISTINCT l_orderkey)::VARCHAR, count(DISTINCT l_partkey)::VARCHAR,
 count(DISTINCT l_suppkey)::VARCHAR, min(l_shipdate)::DATE::VARCHAR, max(l_shipdate)::DATE::VARCHAR]) AS value FROM lineitem""")
def _(t):
    from plumbline.sources import sinks

    path = sinks.scratch(t.spark)
    t.lineitem.withColumn("l_shipdate", F.to_date("l_shipdate")).write.parquet(path)
    total = lambda c: F.round(F.sum(c), 2).cast("decimal(18,2)")
    checks = {"row_count": F.count(F.lit(1)), "sum_price": total("l_extendedprice"), "sum_quantity": total("l_quantity"), "sum_discount": total("l_discount"),
              "distinct_orders": F.count_distinct("l_orderkey"), "distinct_parts": F.count_distinct("l_partkey"), "distinct_suppliers": F.count_distinct("l_suppkey"),
              "min_ship": F.min(F.to_date("l_shipdate")), "max_ship": F.max(F.to_date("l_shipdate"))}
    return M.parity(t.lineitem, t.spark.read.parquet(path), checks).select("check", "match", F.col("left_value").alias("value"))


# What each probe asks for.
PROBES = [("P1", "order_count", ["brand"], ""), ("P2", "customer_count", ["customer"], ""), ("P3", "revenue", ["region", "nation"], ""), ("P4", "revenue", ["c_address"], ""),
          ("P5", "profit_margin", [], ""), ("P6", "revenue; DROP TABLE orders", [], ""), ("P7a", "revenue", ["month"], ""), ("P7b", "revenue", ["quarter"], ""), ("P9", "revenue", ["month"], "2003")]


@query("mx_capability_probes", """SELECT probe, count(*) AS n, CASE WHEN probe IN ('P3', 'P7a', 'P7b') THEN 'answer' ELSE 'refuse' END AS action,
 CASE probe WHEN 'P3' THEN 'nation' WHEN 'P7a' THEN 'month' WHEN 'P7b' THEN 'quarter' ELSE '' END AS dims,
 CASE probe WHEN 'P1' THEN 'grain' WHEN 'P2' THEN 'grain' WHEN 'P4' THEN 'field,grain' WHEN 'P5' THEN 'policy' WHEN 'P6' THEN 'field,policy' WHEN 'P9' THEN 'time' ELSE '' END AS failed
 FROM (SELECT ['P1', 'P2', 'P3', 'P4', 'P5', 'P6', 'P7a', 'P7b', 'P9'][1 + o_orderkey % 9] AS probe FROM orders) GROUP BY 1""")
def _(t):
    at = lambda values: F.get(F.array(*values), (F.col("o_orderkey") % len(PROBES)).cast("int"))
    p = scale.spread(t.orders.select("o_orderkey"), "o_orderkey").select(
        at([F.lit(p[0]) for p in PROBES]).alias("probe"), at([F.lit(p[1]) for p in PROBES]).alias("metric_id"), at([X.lit_list(p[2]) for p in PROBES]).alias("requested"),
        F.nullif(at([F.lit(p[3]) for p in PROBES]), F.lit("")).alias("time_binding"), F.lit("probe of a plan").alias("nl_query"))
    d = C.compile_requests(p, C.contract_of(t.spark, CAT), CAT)
    cert = F.coalesce(F.array_join("decision.trace.certificate.failed_constraints", ","), F.lit(""))
    return d.groupBy("probe", F.col("decision.action").alias("action"), F.array_join("decision.pred_dimensions", "|").alias("dims"), cert.alias("failed")).agg(F.count(F.lit(1)).alias("n"))


@query("mx_schema_tests", """SELECT 'orders' AS tbl, unnest(['unique:o_orderkey', 'unique:o_custkey', 'not_null:o_orderkey', 'not_null:o_orderdate']) AS test, unnest([count(*) - count(DISTINCT o_orderkey), count(*) - count(DISTINCT o_custkey), count(*) - count(o_orderkey), count(*) - count(o_orderdate)]) AS failures FROM orders
 UNION ALL SELECT 'lineitem', unnest(['unique:l_orderkey', 'not_null:l_quantity']), unnest([count(*) - count(DISTINCT l_orderkey), count(*) - count(l_quantity)]) FROM lineitem""")
def _(t):
    a = M.schema_tests(t.orders, ["o_orderkey", "o_custkey"], ["o_orderkey", "o_orderdate"]).withColumn("tbl", F.lit("orders"))
    return a.unionByName(M.schema_tests(t.lineitem, ["l_orderkey"], ["l_quantity"]).withColumn("tbl", F.lit("lineitem")))


def profile_sql(tbl, cols):
    return " UNION ALL ".join(f"SELECT '{tbl}' AS tbl, '{c}' AS col, '{ty}' AS type, count(*) AS rows, count({c}) AS filled, array_to_string(list_sort(list_distinct(list({c}::VARCHAR)))[1:3], '|') AS vals FROM {tbl}" for c, ty in cols)


@query("mx_table_profile", profile_sql("part", [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int")]) + " UNION ALL " +
       profile_sql("customer", [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_mktsegment", "string")]))
def _(t):
    p = M.table_profile(t.part.drop("p_retailprice"), "part").unionByName(M.table_profile(t.customer.drop("c_acctbal"), "customer"))
    return p.withColumn("vals", F.array_join("values", "|")).drop("values")
