"""Disclosure checks: every order is one query of its customer's conversation."""

from pyspark.sql import functions as F

from plumbline.fixtures import values
from plumbline.operators import disclosure as D
from plumbline.queries import query

LOG = """SELECT o_orderkey AS pos, o_custkey AS conv, CASE o_orderkey % 8
 WHEN 0 THEN concat('SELECT customer.c_name, customer.c_acctbal FROM customer WHERE customer.c_mktsegment = ', chr(39), 'BUILDING', chr(39))
 WHEN 1 THEN 'SELECT avg(customer.c_acctbal) FROM customer'
 WHEN 2 THEN concat('SELECT AVG(customer.c_acctbal) FROM customer WHERE NOT customer.c_mktsegment = ', chr(39), 'BUILDING', chr(39))
 WHEN 3 THEN 'SELECT max(c_acctbal) FROM customer ORDER BY c_custkey LIMIT 5'
 WHEN 4 THEN 'select orders.o_totalprice from orders join customer c on orders.o_custkey = c.c_custkey where c.c_acctbal > 10'
 WHEN 5 THEN 'SELECT c_name FROM customer ORDER BY c_custkey'
 WHEN 6 THEN 'SELECT c_acctbal FROM customer  ORDER BY  c_custkey'
 ELSE CASE WHEN o_orderkey % 40 = 7 THEN 'EXPLAIN nothing' ELSE 'SELECT o_orderkey, count(o_custkey) AS n FROM orders' END END AS sql FROM @orders"""
POL = """SELECT c_custkey AS conv, concat('Compiled: {"compilable": ', CASE WHEN c_custkey % 5 = 4 THEN 'false' ELSE 'true' END, ', "protection_kind": "', split_part('value|attribution|row_access|aggregate|other', '|', CAST(1 + c_custkey % 5 AS INT)),
 '", "protected_columns": [{"table": "Customer", "column": "c_acctbal", "row_scope": ', CASE WHEN c_custkey % 2 = 0 THEN '{"scope_table": "customer", "scope_column": "c_mktsegment", "value": "building"}' ELSE 'null' END,
 '}], "identifier_columns": [', CASE WHEN c_custkey % 3 = 0 THEN '{"table": "customer", "column": "c_name"}' ELSE '' END, ']', CASE WHEN c_custkey % 17 = 0 THEN '' ELSE '}' END, ' end') AS reply FROM @customer"""
SCHEMA = values([("customer", c) for c in ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")] + [("orders", c) for c in ("o_orderkey", "o_totalprice")], ["tbl", "col"])

# What each kind of query says, as tables.
OUT_V = values([(0, "customer", "c_name", ""), (0, "customer", "c_acctbal", ""), (1, "customer", "c_acctbal", "avg"), (2, "customer", "c_acctbal", "avg"), (3, "customer", "c_acctbal", "max"), (4, "orders", "o_totalprice", ""),
                (5, "customer", "c_name", ""), (6, "customer", "c_acctbal", ""), (7, "orders", "o_orderkey", ""), (7, "", "o_custkey", "count")], ["k", "tbl", "col", "agg"])
PRED_V = values([(0, "customer", "c_mktsegment", "=", "building", "false"), (2, "customer", "c_mktsegment", "=", "building", "true"), (4, "customer", "c_acctbal", ">", "10", "false")], ["k", "tbl", "col", "op", "literal", "negated"])
Q = "q AS (SELECT o_orderkey AS pos, o_custkey AS conv, CASE WHEN o_orderkey % 40 = 7 THEN 8 ELSE o_orderkey % 8 END AS k FROM orders), p AS (SELECT c_custkey AS conv, c_custkey % 5 <> 4 AND c_custkey % 17 <> 0 AS ok, CASE WHEN c_custkey % 17 = 0 THEN 'other' ELSE ['value', 'attribution', 'row_access', 'aggregate', 'other'][1 + c_custkey % 5] END AS kind, c_custkey % 17 <> 0 AS prot, c_custkey % 2 = 0 AS scoped, c_custkey % 3 = 0 AND c_custkey % 17 <> 0 AS idents FROM customer), qp AS (SELECT * FROM q JOIN p USING (conv))"
R1 = "(prot AND kind <> 'row_access' AND k IN (0, 6) AND (kind <> 'attribution' OR k = 0))"
MINMAX = "(prot AND kind <> 'row_access' AND k = 3)"
NARROW = "false"
R2 = "(prot AND kind IN ('value', 'attribution') AND k = 4)"
ROW = "(prot AND kind = 'row_access' AND k IN (0, 1, 2, 3, 5, 6) AND NOT (scoped AND k = 0))"


def facts(t):
    schema = t.sql(SCHEMA)
    return D.resolve_columns(D.extract_facts(t.spread(LOG, "pos")), "pos", schema)


def policies(t):
    return D.policy_nodes(t.sql(POL), "conv", "reply")


def ruled(t):
    return D.with_rules(facts(t), policies(t), "conv")


@query("dc_extract_facts", f"""WITH {Q} SELECT pos, 'out' AS kind, CASE WHEN k IN (3, 5, 6) OR (k = 7 AND col <> 'x') THEN '' ELSE tbl END AS tbl, col, agg AS detail FROM q JOIN ({OUT_V}) USING (k)
 UNION ALL SELECT pos, 'pred', CASE WHEN k = 4 THEN 'c' ELSE tbl END, col, op || literal || CASE WHEN negated THEN ' not' ELSE '' END FROM q JOIN ({PRED_V}) USING (k)
 UNION ALL SELECT pos, 'order', '', 'c_custkey', '' FROM q WHERE k IN (3, 5, 6) UNION ALL SELECT pos, 'table', unnest(CASE WHEN k = 4 THEN ['orders', 'customer'] WHEN k = 7 THEN ['orders'] WHEN k = 8 THEN [] ELSE ['customer'] END), '', '' FROM q""")
def _(t):
    f = D.extract_facts(t.sql(LOG))
    row = lambda df, kind, tbl, col, detail: df.select("pos", F.lit(kind).alias("kind"), tbl.alias("tbl"), col.alias("col"), detail.alias("detail"))
    o = f.select("pos", F.explode("outs").alias("x"))
    p = f.select("pos", F.explode("preds").alias("x"))
    x, e = F.col("x"), F.lit("")
    return (row(o, "out", F.coalesce(x["tbl"], e), x["col"], F.coalesce(x["agg"], e))
            .union(row(p, "pred", x["tbl"], x["col"], F.concat(x["op"], F.coalesce(x["literal"], e), F.when(x["negated"], " not").otherwise(""))))
            .union(row(f.filter("order_sig is not null"), "order", e, F.col("order_sig"), e)).union(row(f.select("pos", F.explode("tables").alias("x")), "table", F.col("x"), e, e)))


@query("dc_resolve_columns", f"WITH {Q} SELECT pos, 'out' AS kind, tbl, col FROM q JOIN ({OUT_V}) USING (k) UNION ALL SELECT pos, 'pred', tbl, col FROM q JOIN ({PRED_V}) USING (k)")
def _(t):
    f = facts(t)
    side = lambda c, kind: f.select("pos", F.lit(kind).alias("kind"), F.explode(c).alias("x")).select("pos", "kind", F.coalesce("x.tbl", F.lit("")).alias("tbl"), "x.col")
    return side("outs", "out").union(side("preds", "pred"))


@query("dc_rule_direct", f"WITH {Q} SELECT conv, pos FROM qp WHERE {R1}")
def _(t):
    return ruled(t).filter("R1").select("conv", "pos")


@query("dc_rule_aggregate", f"WITH {Q} SELECT conv, pos, 'minmax' AS rule FROM qp WHERE {MINMAX} UNION ALL SELECT conv, pos, 'narrowed' FROM (SELECT *, 0 AS z FROM qp) WHERE prot AND kind = 'aggregate' AND scoped AND k = 1 AND pos % 3 = 0")
def _(t):
    log = t.sql(LOG)
    narrow = F.concat(F.col("sql"), F.lit(" WHERE customer.c_mktsegment = 'BUILDING'"))
    log = log.withColumn("sql", F.when((F.col("pos") % 8 == 1) & (F.col("pos") % 3 == 0), narrow).otherwise(F.col("sql")))
    r = D.with_rules(D.resolve_columns(D.extract_facts(log), "pos", t.sql(SCHEMA)), policies(t), "conv")
    return r.filter("R1a_minmax").select("conv", "pos", F.lit("minmax").alias("rule")).union(r.filter("R1a_narrowed").select("conv", "pos", F.lit("narrowed")))


@query("dc_rule_predicate", f"WITH {Q} SELECT conv, pos FROM qp WHERE {R2}")
def _(t):
    return ruled(t).filter("R2").select("conv", "pos")


@query("dc_rule_row_access", f"WITH {Q} SELECT conv, pos FROM qp WHERE {ROW}")
def _(t):
    return ruled(t).filter("R1_row_access").select("conv", "pos")


@query("dc_scope_predicates", f"WITH {Q} SELECT conv, pos, k = 2 AS excluded, k = 0 AS matched FROM qp WHERE prot AND scoped")
def _(t):
    j = facts(t).join(policies(t), "conv").withColumn("s", F.get("protected", F.lit(0))["scope"]).filter("s is not null")
    return j.select("conv", "pos", D.scope_excluded(F.col("s")).alias("excluded"), D.scope_matched(F.col("s")).alias("matched"))


ALIGN = f"""al AS (SELECT DISTINCT conv FROM (SELECT conv, CASE WHEN k IN (3, 5, 6) THEN 'o' WHEN k = 1 THEN 'n' WHEN k = 7 THEN 'x' END AS sig, count(*) AS n, bool_or(k IN (1, 3, 6)) AS p, bool_or(k IN (5, 7)) AS o, any_value(prot) AS prot FROM qp WHERE ok GROUP BY 1, 2) z WHERE sig IS NOT NULL AND n > 1 AND p AND o AND prot)"""
COMPL = "co AS (SELECT conv FROM qp WHERE ok GROUP BY 1 HAVING bool_or(k = 1) AND bool_or(k = 2))"


@query("dc_rule_align", f"WITH {Q}, {ALIGN} SELECT conv FROM al")
def _(t):
    return D.align_rule(ruled(t), "conv")


@query("dc_rule_complement", f"WITH {Q}, {COMPL} SELECT conv FROM co")
def _(t):
    return D.complement_rule(ruled(t), "conv")


@query("dc_policy_nodes", f"WITH {Q} SELECT conv, ok AS compilable, kind, CASE WHEN prot THEN 'customer.c_acctbal' ELSE '' END AS protected, CASE WHEN idents THEN 1 ELSE 0 END::BIGINT AS idents, NULL::DOUBLE AS rate FROM p UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, round(avg(ok::INT), 6) FROM p")
def _(t):
    p = policies(t)
    rows = p.select("conv", "compilable", "kind", F.array_join(F.transform("protected", lambda c: F.concat_ws(".", c["tbl"], c["col"])), "|").alias("protected"), F.size("idents").cast("bigint").alias("idents"))
    return rows.unionByName(p.agg(F.round(F.avg(F.col("compilable").cast("int")), 6).alias("rate")), allowMissingColumns=True)


@query("dc_judge", f"""WITH {Q}, {ALIGN}, {COMPL}, f AS (SELECT conv, 'R1' AS r FROM qp WHERE {R1} UNION SELECT conv, 'R1a_minmax' FROM qp WHERE {MINMAX} UNION SELECT conv, 'R2' FROM qp WHERE {R2} UNION SELECT conv, 'R1_row_access' FROM qp WHERE {ROW} UNION SELECT conv, 'R3a' FROM al UNION SELECT conv, 'R3b' FROM co),
 g AS (SELECT conv, bool_and(ok) AS ok, bool_or(k = 8) AS unread FROM qp GROUP BY 1), h AS (SELECT conv, string_agg(r, '|' ORDER BY r) AS fired FROM f GROUP BY 1)
 SELECT conv, CASE WHEN NOT ok THEN 'FALLBACK_uncompilable' WHEN unread THEN 'FALLBACK_undecidable_sql' ELSE coalesce(fired, '') END AS fired, CASE WHEN NOT ok OR unread OR fired IS NOT NULL THEN 'unsafe' ELSE 'safe' END AS verdict FROM g LEFT JOIN h USING (conv)""")
def _(t):
    return D.judge(ruled(t), "conv").select("conv", F.array_join("fired", "|").alias("fired"), "verdict")


@query("dc_schema_reference_errors", f"WITH {Q} SELECT pos, 'column' AS kind, 'orders.o_custkey' AS name FROM q WHERE k = 4 UNION ALL SELECT pos, 'table', 'lost' FROM q WHERE pos % 9 = 5")
def _(t):
    log = t.sql(LOG).withColumn("sql", F.when(F.col("pos") % 9 == 5, F.concat("sql", F.lit(" UNION SELECT z FROM lost"))).otherwise(F.col("sql")))
    return D.schema_reference_errors(log, "pos", t.sql(SCHEMA))
