"""Operators against brute force on small inputs."""

import random

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import contract as C, filters as P, joins as JN, linking as L, scale, windows as WN
from plumbline.plans.governed import DIMENSIONS, METRICS, catalog
from plumbline.sources.catalog import METRIC_SCHEMA
from plumbline.sources.readers import catalog_jsonl
from plumbline.streaming.decisions import decide_stream, write_decisions


def test_substring_join_is_contains(spark):
    rnd = random.Random(1)
    texts = [(i, "".join(rnd.choice("abc 按x") for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    terms = sorted({"".join(rnd.choice("abc 按") for _ in range(rnd.randint(1, 5))) for _ in range(30)})
    got = P.substring_join(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame([(x,) for x in terms], "term string"))
    assert {tuple(r) for r in got.select("id", "term").collect()} == {(i, x) for i, t in texts for x in terms if x in t}


def test_substring_join_finds_long_terms(spark):
    long = "x" * 300 + "needle" + "y" * 300
    texts, terms = [(1, "before " + long + " after"), (2, long[:500]), (3, None), (4, "")], [(long,), (long[:70],), ("needle",), ("",)]
    got = P.substring_join(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame(terms, "term string"))
    assert {tuple(r) for r in got.select("id", "term").collect()} == {(1, long), (1, long[:70]), (1, "needle"), (2, long[:70]), (2, "needle")}


def test_closure_of_a_long_chain(spark):
    n = 100
    got = JN.closure(spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(n)], "child string, parent string")).collect()
    assert {(r["child"], r["ancestor"], r["depth"]) for r in got} == {(f"c{i}", f"c{j}", j - i) for i in range(n + 1) for j in range(i + 1, n + 1)}


def test_exact_tests_of_large_counts(spark):
    from math import comb

    from plumbline.operators import stats as ST

    rows = [(0, 0), (1, 0), (5, 9), (40, 80), (300, 310), (10**9, 10**9), (10**9, 10**9 + 200_000), (3, 10**6)]
    got = spark.createDataFrame(rows, "b long, c long").withColumn("p", ST.mcnemar_p("b", "c")).collect()
    for r in got[:5]:
        n, low = r["b"] + r["c"], min(r["b"], r["c"])
        want = min(1.0, 2 * sum(comb(n, k) for k in range(low + 1)) / 2**n)
        assert abs(r["p"] - want) < 1e-9
    assert got[5]["p"] == 1.0 and 1e-6 < got[6]["p"] < 1e-4 and got[7]["p"] < 1e-60
    tables = [(3, 1, 2, 6), (10, 0, 0, 10), (200, 180, 150, 190), (10**6, 10**6, 10**6, 10**6 + 3000)]
    got = ST.with_fisher(spark.createDataFrame(tables, "a long, b long, c long, d long"), "a", "b", "c", "d").collect()
    for r in got[:3]:
        a, b, c, d = r["a"], r["b"], r["c"], r["d"]
        p = lambda x: comb(a + b, x) * comb(c + d, a + c - x) / comb(a + b + c + d, a + c)
        want = sum(p(x) for x in range(max(0, a - d), min(a + b, a + c) + 1) if p(x) <= p(a) * (1 + 1e-9))
        assert abs(r["p"] - want) < 1e-8
    assert 0.1 < got[3]["p"] < 0.3


def test_entities_beyond_their_pool_are_named(spark):
    from plumbline.operators import curation as CU

    names = [f"Place{i}x" for i in range(9)] + ["A.B\\E(c)", "zz"]
    rows = [(" and ".join(names), [(n, "place") for n in names[:9]] + [("A.B\\E(c)", "planet"), ("zz", "other")])]
    df = spark.createDataFrame(rows, "t string, e array<struct<surface:string,type:string>>").withColumn("m", CU.entity_map("t", "e", F.array(F.lit("orders"))))
    r = df.select(CU.substitute(F.col("t"), F.col("m")).alias("new"), CU.skipped_entities(F.col("e"), F.col("m")).alias("skipped")).first()
    pool = CU.POOLS["place"]
    assert r["new"] == " and ".join([*pool, *names[len(pool):9], CU.POOLS["other"][0], "zz"])
    assert [tuple(x) for x in r["skipped"]] == [(n, "pool used up") for n in names[len(pool):9]] + [("zz", "too short")]


def test_contracts_of_thousands_of_rows(spark):
    """600 metrics and more than 1,000 edges: the copies decide as the metrics they were copied from."""
    small = catalog()
    copies = [dict(m, metric_id=f"{m['metric_id']}_{i}") for i in range(600 // len(METRICS) + 1) for m in METRICS]
    edges = [dict(e, **{k: f"{e[k]}_{i}" for k in ("src", "dst", "metric_id") if e.get(k) in {m["metric_id"] for m in METRICS}}) for i in range(600 // len(METRICS) + 1) for e in small.edges]
    edges += [dict(small.edges[0], src=f"s{i}", dst=f"d{i}") for i in range(max(0, 1100 - len(edges)))] if small.edges else []
    large = type(small)(**{**small.__dict__, "metrics": copies, "edges": edges})
    assert len(copies) > 512
    rows = [(i, f"{m['metric_name']} by region in 1997", m["metric_id"]) for i, m in enumerate(METRICS)]
    ask = lambda name: spark.createDataFrame([(i, q, name(m)) for i, q, m in rows], "request_id int, nl_query string, metric_id string")
    decide = lambda df, cat: {r["request_id"]: r["a"] for r in C.compile_requests(df, C.contract_of(spark, cat), cat).select("request_id", F.col("decision.action").alias("a")).collect()}
    assert decide(ask(lambda m: f"{m}_7"), large) == decide(ask(lambda m: m), small)


def test_alias_join_is_the_inline_rule(spark):
    texts = [(0, "orders by market segment"), (1, "reorders by segments"), (2, "按客户的订单数"), (3, "a-b test, price per unit"), (4, "")]
    aliases = ["orders", "segment", "market segment", "客户", "a-b", "price per unit", "per"]
    got = JN.alias_join(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame([(a,) for a in aliases], "alias string"))
    df = spark.createDataFrame(texts, "id int, t string")
    want = {(r["id"], a) for a in aliases for r in df.filter(X.contains_any_alias(F.col("t"), [a])).collect()}
    assert {tuple(r) for r in got.select("id", "alias").collect()} == want
    assert (0, "orders") in want and (1, "orders") not in want and (2, "客户") in want


def test_closure_ends_at_a_cycle(spark):
    got = JN.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "")], "child string, parent string")).collect()
    assert {(r["child"], r["ancestor"]) for r in got} == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "b"), ("c", "b"), ("c", "c")}


def test_finest_forms_agree(spark):
    cat = catalog()
    ids = [d["dimension_id"] for d in DIMENSIONS]
    rnd = random.Random(2)
    rows = [(i, rnd.sample(ids, rnd.randint(0, 5))) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, dims array<string>")
    inline = {r["id"]: set(r["f"]) for r in df.select("id", C.finest(F.col("dims"), cat).alias("f")).collect()}
    parents = spark.createDataFrame([(d["dimension_id"], d["parent"]) for d in DIMENSIONS], "child string, parent string")
    joined = JN.finest(df.select("id", F.explode("dims").alias("dim")), JN.closure(parents), "id").collect()
    assert {i: {r["dim"] for r in joined if r["id"] == i} for i, _ in rows} == inline


def test_positions_and_chunks(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 37 % 101).alias("v"), (F.col("id") % 3 == 0).cast("int").alias("k"))
    p = scale.positions(df, ["v", "id"], F.floor(F.col("v") / 10), ["k"]).collect()
    for k in (0, 1):
        rows = sorted((r["v"], r["id"], r["pos"]) for r in p if r["k"] == k)
        assert [r[2] for r in rows] == list(range(1, len(rows) + 1))
    chunks = WN.split_evenly(df, ["v", "id"], F.floor(F.col("v") / 10), 7).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in chunks] == [143] * 6 + [142]


def test_value_ranks(spark):
    rnd = random.Random(3)
    values = [rnd.choice([0.5, 1.0, 7.25, -3.0, 12.0]) for _ in range(200)]
    r = scale.value_ranks(spark.createDataFrame([(v,) for v in values], "x double"), "x", width=5.0)
    got = r.agg(*[scale.value_at(F.lit(k)).alias(f"k{k}") for k in (1, 57, 200)]).collect()[0]
    assert list(got) == [sorted(values)[k - 1] for k in (1, 57, 200)]


def test_word_set_similarity():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rnd = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 20))) for _ in range(2))
        assert L.common_length(a, b) == lcs(a, b)
    assert L.token_set_ratio({"order", "count"}, {"count", "order", "by"}) == 100.0
    assert L.token_set_ratio(set(), {"a"}) == 0.0
    assert round(L.token_set_ratio({"revenue"}, {"revenues"}), 4) == 93.3333


def test_reply_helpers(spark):
    rows = [('x {"a": {"b": 1}} y {"c": 2} }',), ("{bad} {",), ("",), (None,), ('{"k": "}"}',)]
    got = spark.createDataFrame(rows, "t string").select(X.first_json_object("t").alias("f"), X.last_json_object("t").alias("l")).collect()
    assert [r["f"] for r in got] == ['{"a": {"b": 1}}', None, None, None, '{"k": "}"}']
    assert [r["l"] for r in got[:3]] == ['{"c": 2}', None, None]


def test_absent_catalog_is_empty(spark, tmp_path):
    assert catalog_jsonl(spark, str(tmp_path / "none.jsonl"), METRIC_SCHEMA).isEmpty()


def test_decisions_hold_under_filters(spark):
    cat = catalog()
    df = spark.createDataFrame([(0, "revenue by region", "revenue"), (1, "raw rows of revenue", "revenue"), (2, "profit margin", "profit_margin")], "id int, nl_query string, metric_id string")
    d = C.compile_requests(df, C.contract_of(spark, cat), cat)
    assert [r["id"] for r in d.filter("decision.action = 'answer'").collect()] == [0]
    assert {r["id"] for r in d.filter("decision.trace.certificate.primary_failure = 'policy'").collect()} == {1, 2}


def test_decisions_over_a_stream(spark, tmp_path):
    cat = catalog()
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(i, f"{m['aliases'][0]} by region", m["metric_id"]) for i, m in enumerate(METRICS)], "id int, nl_query string, metric_id string")
    df.write.parquet(src)
    q = write_decisions(decide_stream(spark, src, df.schema, cat).select("id", "decision.action", "decision.reason"), out, str(tmp_path / "ck"))
    q.awaitTermination(120)
    want = {(r["id"], r["action"]) for r in C.compile_requests(df, C.contract_of(spark, cat), cat).select("id", "decision.action").collect()}
    assert {(r["id"], r["action"]) for r in spark.read.parquet(out).collect()} == want


def test_tool_calls_nest_to_any_depth(spark):
    deep = "select " + "f(" * 40 + "x" + ")" * 40
    queries = ["select sum(round(x, 1)) from t", "select count(distinct lower(trim(x))) from t", deep, "select 1"]
    reply = "plan (a\n" + "\n".join(f'  @sql_execution(query="{q}")' for q in queries) + '\ntext @sql_draft(query="no")\n@add_schema(table="t",\n column="u")\n@sql_draft(query="open(\n@stop()'
    rows = spark.createDataFrame([(0, reply), (1, None), (2, "")], "id int, r string").select("id", X.tool_calls(F.col("r")).alias("c")).orderBy("id").collect()
    assert [(c.tool, c.query) for c in rows[0].c] == [*(("sql_execution", q) for q in queries), ("add_schema", ""), ("sql_draft", "open(\n@stop()")]  # cut off: up to the end
    assert (rows[0].c[4].table, rows[0].c[4].column) == ("t", "u")
    assert rows[1].c is None and rows[2].c == []
    bare = "@sql_draft(query = select max(f(x)) from t)\n@sql_execution(query='select 1\nfrom t"
    cut = spark.createDataFrame([(bare,)], "r string").select(X.tool_calls(F.col("r")).alias("c")).collect()[0].c
    assert [(c.tool, c.query) for c in cut] == [("sql_draft", "select max(f(x)) from t"), ("sql_execution", "select 1\nfrom t")]
