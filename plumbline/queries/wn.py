"""Windows, sorting and set operations."""

from pyspark.sql import functions as F

from plumbline.operators import scale, scoring as S, windows as WN
from plumbline.queries import query
from plumbline.queries.ag import FL, LIST, flags


@query("wn_topk_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS rank FROM lineitem) WHERE rank <= 5")
def _(t):
    k = scale.first_k(t.lineitem, ["l_suppkey"], [F.desc(c) for c in ("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")], 5)
    return k.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("rank").cast("bigint").alias("rank"))


@query("wn_first_per_key", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def _(t):
    return WN.extremes(t.events, "user_id", ["ts", "event_id"], ["event_id", "event_type"])


@query("wn_last_per_key", "SELECT request_id, round, action FROM @rounds r QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY round DESC) = 1")
def _(t):
    return WN.extremes(t.rounds, "request_id", ["round"], ["round", "action"], last=True)


@query("wn_rank_methods", f"""SELECT query_family, mode, acc, rank() OVER (PARTITION BY query_family ORDER BY acc DESC) AS rank, array_to_string(list(mode) OVER (PARTITION BY query_family ORDER BY acc DESC, mode ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), '|') AS ranked FROM (SELECT query_family, mode, round(avg(jo::INT), 6) AS acc FROM {FL} f GROUP BY 1, 2) z""")
def _(t):
    from pyspark.sql import Window as W

    g = flags(t).groupBy("query_family", "mode").agg(S.rate(F.col("joint_ok")).alias("acc"))
    lists = g.groupBy("query_family").agg(F.array_join(S.rank_list(g, "acc"), "|").alias("ranked"))
    # a handful of methods per family
    return g.withColumn("rank", F.rank().over(W.partitionBy("query_family").orderBy(F.desc("acc"))).cast("bigint")).join(lists, "query_family")


@query("wn_split_evenly", "SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderdate, o_orderkey) AS chunk FROM orders")
def _(t):
    return WN.split_evenly(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], (F.to_date("o_orderdate"), F.floor(F.col("o_orderkey") / 65536)), 7).select("o_orderkey", "chunk")


@query("wn_half_split", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CASE WHEN row_number() OVER w <= count(*) OVER (PARTITION BY l_suppkey) // 2 THEN 1 ELSE 2 END AS half FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)")
def _(t):
    li = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return WN.half_split(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], scale.key_buckets("l_orderkey", 1024), ["l_suppkey"]).drop("l_extendedprice")


@query("wn_batch_assign", "SELECT doc_id, batch, round(sum(length(text)) OVER (PARTITION BY batch) / count(*) OVER (PARTITION BY batch), 6) AS chars_each FROM (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM documents)")
def _(t):
    b = WN.batches(t.documents.select("doc_id", F.length("text").alias("n")), ["doc_id"], scale.key_buckets("doc_id", 1024), 16)
    per = b.groupBy("batch").agg(F.round(F.sum("n") / F.count(F.lit(1)), 6).alias("chars_each"))
    return b.join(per, "batch").select("doc_id", "batch", "chars_each")


@query("so_global_topn", "SELECT p_partkey, round(sum(l_extendedprice), 4) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY value DESC, p_partkey LIMIT 20")
def _(t):
    j = t.lineitem.join(t.part.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_partkey").agg(F.round(F.sum("l_extendedprice"), 4).alias("value")).orderBy(F.desc("value"), "p_partkey").limit(20)


@query("so_multi_key", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_extendedprice) AS pos FROM lineitem")
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return scale.positions(li, ["l_quantity", "l_linenumber", "l_partkey", "l_extendedprice"], F.floor("l_quantity"), ["l_orderkey"]).drop("l_quantity", "l_extendedprice")


@query("se_union_layers", "SELECT 'base' AS layer, request_id, action FROM @predictions p UNION ALL SELECT 'rounds', request_id, action FROM @rounds r UNION ALL SELECT 'samples', request_id, action FROM @samples s")
def _(t):
    tag = lambda df, name: df.select(F.lit(name).alias("layer"), "request_id", "action")
    return tag(t.predictions, "base").unionByName(tag(t.rounds, "rounds")).unionByName(tag(t.samples, "samples"))


@query("se_intersect_scope", "SELECT l_partkey, l_returnflag FROM (SELECT l_partkey, l_returnflag, count(DISTINCT l_linestatus) AS have FROM lineitem GROUP BY 1, 2) JOIN (SELECT l_partkey, count(DISTINCT l_linestatus) AS n FROM lineitem GROUP BY 1) USING (l_partkey) WHERE have = n")
def _(t):
    return WN.intersect_scope(t.lineitem, "l_partkey", "l_linestatus", "l_returnflag")


@query("se_except_universe", "SELECT k, 'left' AS side FROM (SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer) UNION ALL SELECT k, 'right' FROM (SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey FROM orders)")
def _(t):
    return WN.except_both_ways(t.orders.select(F.col("o_custkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k")))


@query("se_subset_equal", "SELECT mode, request_id, list_sort(string_split(pred_dims, '|')) = list_sort(string_split(expected_dims, '|')) AS equal, expected_dims = '' OR list_has_all(string_split(pred_dims, '|'), string_split(expected_dims, '|')) AS subset FROM @scored s")
def _(t):
    d = t.scored.select("mode", "request_id", LIST("pred_dims").alias("p"), LIST("expected_dims").alias("g"))
    return d.select("mode", "request_id", S.same_set("p", "g").alias("equal"), WN.is_subset("g", "p").alias("subset"))


@query("se_distinct_keep_order", "SELECT request_id, CASE WHEN d1 = d2 THEN d1 || '|brand' WHEN 'brand' IN (d1, d2) THEN d1 || '|' || d2 ELSE d1 || '|' || d2 || '|brand' END AS dims FROM @requests r WHERE NOT (d1 = 'brand' AND d2 = 'brand') UNION ALL SELECT request_id, 'brand' FROM @requests r WHERE d1 = 'brand' AND d2 = 'brand'")
def _(t):
    return t.requests.select("request_id", F.array_join(F.array_distinct(F.array("d1", "d2", "d1", F.lit("brand"), "d2")), "|").alias("dims"))
