"""Sources and sinks, fed with files written from the given tables."""

from pyspark.sql import functions as F

from plumbline.operators import scale
from plumbline.queries import query
from plumbline.sources import readers as R, sinks as S
from plumbline.sources.catalog import METRIC_SCHEMA, PROFILE_SCHEMA


@query("src_catalog_jsonl", """SELECT concat('m_', p_partkey) AS metric_id, p_name AS metric_name, p_type || '|' || p_brand AS aliases, p_partkey % 3 <> 0 AS answerable, NULL::VARCHAR AS domain_id FROM part""")
def _(t):
    path = S.scratch(t.spark)
    rows = t.part.select(F.concat(F.lit("m_"), "p_partkey").alias("metric_id"), F.col("p_name").alias("metric_name"),
                         F.array("p_type", "p_brand").alias("aliases"), (F.col("p_partkey") % 3 != 0).alias("answerable"))
    S.write_jsonl(rows, path)
    got = R.catalog_jsonl(t.spark, path, METRIC_SCHEMA).unionByName(R.catalog_jsonl(t.spark, path + "-absent", METRIC_SCHEMA))
    return got.select("metric_id", "metric_name", F.array_join("aliases", "|").alias("aliases"), "answerable", "domain_id")


@query("src_json_doc", """SELECT s_name AS dataset_id, 'a' || s_nationkey AS anchor, n_name AS alias FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def _(t):
    path = S.scratch(t.spark)
    doc = F.to_json(F.struct(F.col("s_name").alias("dataset_id"), F.create_map(F.concat(F.lit("a"), "s_nationkey"), F.array("n_name")).alias("time_aliases")))
    docs = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.replace(doc, F.lit(","), F.concat(F.lit(","), F.lit("\n"))).alias("value"))
    S.write_docs(docs, "s_suppkey", "value", path)
    got = R.json_doc(t.spark, path, PROFILE_SCHEMA).unionByName(R.json_doc(t.spark, path + "-absent", PROFILE_SCHEMA), allowMissingColumns=True)
    return got.select("dataset_id", F.explode("time_aliases").alias("anchor", "a")).select("dataset_id", "anchor", F.explode("a").alias("alias"))


@query("src_csv_snapshot", """SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::VARCHAR AS l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS qty,
 CASE WHEN l_linenumber = 2 THEN 0 ELSE l_suppkey::INTEGER END AS pack, strftime(l_shipdate, '%Y-%m-%d') AS ordered_on FROM lineitem""")
def _(t):
    path = S.scratch(t.spark)
    t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("qty"),
        F.when(F.col("l_linenumber") == 2, "").otherwise(F.col("l_suppkey").cast("string")).alias("pack"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("ordered_on"),
    ).write.option("header", True).csv(path)
    return R.csv_snapshot(t.spark, path, numbers=["qty"], whole=["pack"], dates=["ordered_on"])


@query("src_typed_cast_table", """SELECT o_orderkey::VARCHAR AS k, strftime(o_orderdate, '%Y-%m-%d') AS d, o_custkey::INTEGER AS c, o_totalprice AS p FROM orders""")
def _(t):
    raw = t.orders.select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"),
                          F.col("o_custkey").cast("string").alias("c"), F.col("o_totalprice").cast("string").alias("p"))
    return R.typed(raw, {"k": "string", "d": "date", "c": "int", "p": "double"}).withColumn("d", F.col("d").cast("string"))


MANIFESTS = """SELECT p_partkey AS manifest_id, concat('{"semantic_models": [{"name": "', p_brand, '", "measures": [{"name": "amt", "agg": "sum", "expr": "', p_type, '"}, {"name": "cnt", "agg": "count", "expr": "1"}],
 "entities": [{"name": "part", "type": "primary"}, {"name": "sup', CAST(p_size AS STRING), '", "type": "foreign"}], "dimensions": [{"name": "', p_name, '", "type": "categorical"}]}],
 "metrics": [{"name": "avg_amt", "type": "ratio", "numerator": "amt", "denominator": "cnt"}]}') AS manifest, p_brand, p_type, p_size, p_name FROM @part"""


@query("src_manifest", f"""WITH m AS ({MANIFESTS}) SELECT manifest_id, 'model' AS kind, p_brand AS name, '' AS detail FROM m
 UNION ALL SELECT manifest_id, 'measure', 'amt', 'sum:' || p_type FROM m UNION ALL SELECT manifest_id, 'measure', 'cnt', 'count:1' FROM m
 UNION ALL SELECT manifest_id, 'entity', 'part', 'primary' FROM m UNION ALL SELECT manifest_id, 'entity', 'sup' || p_size, 'foreign' FROM m
 UNION ALL SELECT manifest_id, 'dimension', p_name, 'categorical' FROM m UNION ALL SELECT manifest_id, 'metric', 'avg_amt', 'amt/cnt' FROM m""")
def _(t):
    m = R.manifest(t.sql(MANIFESTS))
    pick = lambda df, kind, name, detail: df.select("manifest_id", F.lit(kind).alias("kind"), F.col(name).alias("name"), detail.alias("detail"))
    return R.concat_parts([
        pick(m["models"], "model", "model", F.lit("")), pick(m["measures"], "measure", "name", F.concat_ws(":", "agg", "expr")),
        pick(m["entities"], "entity", "name", F.col("type")), pick(m["dimensions"], "dimension", "name", F.col("type")),
        pick(m["metrics"], "metric", "name", F.concat_ws("/", "numerator", "denominator")),
    ])


@query("src_schema_doc", """SELECT 'db' || s_suppkey AS db_id, s_name AS tbl, 'bal' AS col, 1::BIGINT AS pos FROM supplier
 UNION ALL SELECT 'db' || s_suppkey, 'nation_' || s_nationkey, 'key ' || s_nationkey, 2 FROM supplier""")
def _(t):
    col = lambda i, name: F.struct(F.lit(i).alias("table_idx"), name.alias("name"))
    docs = t.supplier.select(
        F.concat(F.lit("db"), "s_suppkey").alias("db_id"), F.array("s_name", F.concat(F.lit("nation_"), "s_nationkey")).alias("table_names"),
        F.array(col(-1, F.lit("*")), col(0, F.lit("bal")), col(1, F.concat(F.lit("key "), "s_nationkey"))).alias("column_names"))
    return R.schema_doc(docs).select("db_id", F.col("table").alias("tbl"), F.col("column").alias("col"), F.col("pos").cast("bigint").alias("pos"))


DDL = """SELECT concat('db', CAST(p_partkey AS STRING)) AS db_id, concat('CREATE TABLE "', p_name, '" (', chr(10), '  `', p_type, ' Id` INTEGER, -- key of ', p_brand, chr(10), '  size INT', chr(10), '  PRIMARY KEY (x)', chr(10), ');', chr(10),
 'create table t', CAST(p_size AS STRING), ' (', chr(10), ' [c1] text, -- note', chr(10), ')') AS ddl, p_name, p_type, p_brand, p_size FROM @part"""


@query("src_ddl_columns", f"""SELECT db_id, replace(p_name, ' ', '_') AS tbl, lower(p_type) AS col, 'key of ' || p_brand AS comment FROM ({DDL}) a
 UNION ALL SELECT db_id, replace(p_name, ' ', '_'), 'size', '' FROM ({DDL}) b UNION ALL SELECT db_id, 't' || p_size, 'c1', 'note' FROM ({DDL}) c""")
def _(t):
    return R.ddl_columns(t.sql(DDL)).select("db_id", F.col("table").alias("tbl"), F.col("column").alias("col"), "comment")


LISTING = """SELECT concat('db', CAST(p_partkey AS STRING)) AS db_id, concat('table part , columns = [ part.id ( int | primary key ) , part.', lower(p_type), ' ( text ) ]', chr(10), 'table s', CAST(p_size AS STRING), ' , columns = [ s.a ( real ) ]') AS listing, p_type, p_size FROM @part"""


@query("src_schema_listing", f"""SELECT db_id, 'part' AS tbl, 'id' AS col, true AS is_pk FROM ({LISTING}) a UNION ALL SELECT db_id, 'part', lower(p_type), false FROM ({LISTING}) b UNION ALL SELECT db_id, 's' || p_size, 'a', false FROM ({LISTING}) c""")
def _(t):
    return R.schema_listing(t.sql(LISTING)).select("db_id", F.col("table").alias("tbl"), F.col("column").alias("col"), "is_pk")


@query("src_multi_part_concat", """SELECT c_name AS name, c_acctbal AS bal, c_mktsegment AS segment, NULL::BIGINT AS k FROM customer UNION ALL BY NAME SELECT s_name AS name, s_acctbal AS bal, s_suppkey AS k FROM supplier UNION ALL BY NAME SELECT n_name AS name FROM nation""")
def _(t):
    return R.concat_parts([
        t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment")),
        t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("k")),
        t.nation.select(F.col("n_name").alias("name")),
    ])


@query("src_positional_pair", """SELECT o_orderkey, l_orderkey, l_linenumber, pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos FROM orders)
 JOIN (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem) USING (pos)""")
def _(t):
    left = scale.positions(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], (F.floor(F.col("o_totalprice") / 1000), F.floor(F.col("o_totalprice"))))
    right = scale.positions(t.lineitem, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], (F.to_date("l_shipdate"), F.floor(F.col("l_orderkey") / 65536)))
    return R.positional_pair(left.select("o_orderkey", "pos"), right.select("l_orderkey", "l_linenumber", "pos"))


@query("snk_jsonl", """SELECT concat('{"action":"', CASE WHEN request_id % 2 = 0 THEN 'answer' ELSE 'refuse' END, '","case_id":"', case_id, '","metric":"', g_metric, '"}') AS line FROM @requests r""")
def _(t):
    path = S.scratch(t.spark)
    rows = t.requests.select(F.col("g_metric").alias("metric"), "case_id", F.when(F.col("request_id") % 2 == 0, "answer").otherwise("refuse").alias("action"))
    S.write_jsonl(rows, path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query("snk_resumable_append", """SELECT request_id, CASE WHEN tpl < 4 THEN 'run1' ELSE 'run2' END AS run FROM @requests r""")
def _(t):
    path = S.scratch(t.spark)
    r = t.requests.select("request_id", "tpl")
    S.resume_append(r.filter("tpl < 4").drop("tpl"), path, "request_id", "run1")
    return S.resume_append(r.drop("tpl"), path, "request_id", "run2").select("request_id", "run")
