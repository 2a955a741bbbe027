"""Result-set comparison: per brand, a gold result and four renderings of it."""

from pyspark.sql import functions as F

from plumbline.operators import results as RC
from plumbline.queries import query

GOLD = """SELECT p_brand AS instance, month, flag, CAST(ROUND(SUM(l_quantity), 0) AS DOUBLE) AS qty, COUNT(*) AS n FROM (SELECT p_brand, substr(CAST(l_shipdate AS STRING), 1, 7) AS month, l_returnflag AS flag, l_quantity FROM @lineitem JOIN @part ON l_partkey = p_partkey) x GROUP BY p_brand, month, flag"""
# 0 renames and shuffles, 1 adds a little noise, 2 is wrong for every third brand, 3 drops a row and fails for every fifth brand.
BRAND = "CAST(substr(instance, 7) AS BIGINT)"


RENDERED = "array<struct<candidate:int,row_no:bigint,col:string,value:string>>"


def cells(t):
    """Gold and candidate cells of one aggregate: its rows are rendered once, each row as all cells made of it."""
    row, again = F.xxhash64("month", "flag"), F.xxhash64(F.concat_ws("/", "month", "flag"))
    brand = F.substring("instance", 7, 9).cast("int")
    cell = lambda k, at, col, c: F.struct(F.lit(k).alias("candidate"), at.alias("row_no"), F.lit(col).alias("col"), c.cast("string").alias("value"))
    month, flag, qty, n = (F.col(c) for c in ("month", "flag", "qty", "n"))
    wrong = F.when((brand % 3 == 0) & (flag == "R"), qty + 1).otherwise(qty)
    made = [
        [cell(-1, row, "month", month), cell(-1, row, "flag", flag), cell(-1, row, "qty", qty)],
        [cell(0, again, "f", flag), cell(0, again, "total", qty), cell(0, again, "m", month)],
        [cell(1, row, "month", month), cell(1, row, "flag", flag), cell(1, row, "qty", qty + 0.005), cell(1, row, "extra", n)],
        [cell(2, row, "month", month), cell(2, row, "flag", flag), cell(2, row, "qty", wrong)]]
    third = F.array(cell(3, row, "month", month), cell(3, row, "flag", flag), cell(3, row, "qty", qty))
    runs = F.when((brand % 5 != 0) & (month != "1997-03"), third).otherwise(F.array().cast(RENDERED))
    flat = t.sql(GOLD).select("instance", F.explode(F.concat(*[F.array(*m) for m in made], runs)).alias("x")).select("instance", "x.*")
    return flat.filter("candidate < 0").drop("candidate"), flat.filter("candidate >= 0")


INST = f"i AS (SELECT DISTINCT instance, {BRAND} AS b FROM ({GOLD}) g), hr AS (SELECT DISTINCT instance FROM ({GOLD}) g WHERE flag = 'R'), hm AS (SELECT DISTINCT instance FROM ({GOLD}) g WHERE month = '1997-03'), j AS (SELECT i.*, hr.instance IS NOT NULL AS has_r, hm.instance IS NOT NULL AS has_m FROM i LEFT JOIN hr USING (instance) LEFT JOIN hm USING (instance))"


@query("rc_column_match", f"""WITH {INST} SELECT instance, 0 AS candidate, true AS match FROM j UNION ALL SELECT instance, 1, true FROM j UNION ALL SELECT instance, 2, NOT (b % 3 = 0 AND has_r) FROM j UNION ALL SELECT instance, 3, NOT has_m FROM j WHERE b % 5 <> 0""")
def _(t):
    gold, pred = cells(t)
    return RC.column_match(pred, gold)


@query("rc_table_equal", f"""WITH {INST} SELECT instance, 0 AS candidate, true AS equal FROM j UNION ALL SELECT instance, 1, false FROM j UNION ALL SELECT instance, 2, NOT (b % 3 = 0 AND has_r) FROM j UNION ALL SELECT instance, 3, NOT has_m FROM j WHERE b % 5 <> 0""")
def _(t):
    gold, pred = cells(t)
    return RC.table_equal(pred, gold)


@query("rc_execution_accuracy", f"""WITH {INST}, e AS (SELECT 0 AS candidate, true AS equal FROM j UNION ALL SELECT 1, false FROM j UNION ALL SELECT 2, NOT (b % 3 = 0 AND has_r) FROM j UNION ALL SELECT 3, CASE WHEN b % 5 = 0 THEN NULL ELSE NOT has_m END FROM j)
 SELECT candidate, count(equal) AS scored, count(*) - count(equal) AS skipped, round(coalesce(avg(equal::INT), 0), 6) AS execution_accuracy FROM e GROUP BY 1""")
def _(t):
    gold, pred = cells(t)
    asked = gold.select("instance").distinct().withColumn("candidate", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    return RC.execution_accuracy(asked.join(RC.table_equal(pred, gold), ["instance", "candidate"], "left"), ["candidate"])


CL = f"""{INST}, c AS (SELECT instance, 0 AS candidate, 0 AS cluster FROM j UNION ALL SELECT instance, 1, 0 FROM j UNION ALL SELECT instance, 2, CASE WHEN b % 3 = 0 AND has_r THEN 2 ELSE 0 END FROM j UNION ALL SELECT instance, 3, CASE WHEN has_m THEN 3 ELSE 0 END FROM j WHERE b % 5 <> 0)"""


def clustered(t):
    return RC.clusters(cells(t)[1])


@query("rc_cluster_results", f"WITH {CL} SELECT instance, candidate, cluster, count(*) OVER (PARTITION BY instance, cluster) AS size FROM c")
def _(t):
    return clustered(t)


# What became of every run: all runs of a brand whose number ends in 7 failed, one run of every fifth brand.
FAILED = f"(candidate = 3 AND {BRAND} % 5 = 0) OR {BRAND} % 10 = 7"


@query("rc_select_consistent", f"""WITH {CL}, s AS (SELECT instance, cluster, count(*) AS n FROM c WHERE NOT ({FAILED}) GROUP BY 1, 2) SELECT instance, cluster AS candidate, 'selected' AS status FROM s QUALIFY rank() OVER (PARTITION BY instance ORDER BY n DESC) = 1
 UNION ALL SELECT instance, 0, 'all_failed' FROM i WHERE instance NOT IN (SELECT instance FROM s)""")
def _(t):
    runs = t.sql(GOLD).select("instance").distinct().withColumn("candidate", F.explode(F.array(*[F.lit(i) for i in range(4)]))).withColumn("failed", F.expr(FAILED))
    succeeded = runs.filter("NOT failed").select("instance", "candidate")
    return RC.select_consistent(RC.clusters(cells(t)[1].join(succeeded, ["instance", "candidate"])), runs)


STAGE = "SELECT o_orderkey AS instance, o_orderkey % 4 <> 0 AS ok, concat('gen ', CAST(o_orderkey AS STRING)) AS sql, CASE WHEN o_orderkey % 4 = 0 THEN 'first error' END AS error FROM @orders"
REVISED = "SELECT o_orderkey AS instance, o_orderkey % 8 = 0 AS ok, concat('rev ', CAST(o_orderkey AS STRING)) AS sql, CASE WHEN o_orderkey % 8 <> 0 THEN 'second error' END AS error FROM @orders WHERE o_orderkey % 12 <> 0"


@query("rc_candidate_fallback", """SELECT o_orderkey AS instance, CASE WHEN o_orderkey % 4 <> 0 OR o_orderkey % 12 = 0 THEN 'gen ' || o_orderkey ELSE 'rev ' || o_orderkey END AS sql, CASE WHEN o_orderkey % 4 <> 0 OR (o_orderkey % 8 = 0 AND o_orderkey % 12 <> 0) THEN 'success' ELSE 'error' END AS status,
 CASE WHEN o_orderkey % 4 <> 0 THEN NULL WHEN o_orderkey % 12 = 0 THEN 'first error' WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'second error' END AS error FROM orders""")
def _(t):
    return RC.candidate_fallback(t.sql(STAGE), t.sql(REVISED), ["instance"])


RUNS = """SELECT l_orderkey AS item, CAST(l_linenumber AS BIGINT) * 1000000000000000 + l_partkey * 100000 + l_suppkey AS pos, CASE WHEN l_suppkey % 11 = 0 THEN NULL WHEN l_suppkey % 7 = 0 THEN 0 ELSE l_suppkey END AS rows, split_part('SA|SU|DI|safe|RE', '|', CAST(1 + l_orderkey % 5 AS INT)) AS label, l_orderkey % 25 AS db FROM @lineitem"""


@query("rc_nonempty_split", f"""WITH r AS ({RUNS}), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY item ORDER BY pos DESC) = 1), k AS (SELECT item, CASE WHEN db IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2) THEN 'in_list' ELSE 'out_list' END AS part FROM l WHERE lower(label) IN ('sa', 'su', 'safe') AND rows > 0)
 SELECT item, pos, CASE WHEN rows IS NULL THEN 'failed' WHEN rows = 0 THEN 'empty' ELSE 'non_empty' END AS status, part FROM r LEFT JOIN k USING (item)""")
def _(t):
    known = t.nation.filter("n_regionkey < 2").select(F.col("n_nationkey").cast("bigint").alias("db"))
    return RC.nonempty_split(t.sql(RUNS), "item", known, "db")
