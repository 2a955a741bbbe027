"""Golden cases: 32 sales requests, one mutation per check family, isolation of metric evidence."""

from pyspark.sql import functions as F

from plumbline.operators import contract as C, linking as L
from plumbline.sources.catalog import BINDING_SCHEMA, COVERAGE_SCHEMA, EDGE_SCHEMA, METRIC_SCHEMA, Catalog, rows_of
from tests import golden as G

CAT = Catalog(metrics=G.METRICS, dimensions=G.DIMENSIONS, profile=G.PROFILE, schema_columns=G.COLUMNS)


def test_sales_requests(spark):
    cases = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(G.CASES)], "id int, nl_query string")
    fields = L.field_rows(CAT.metric_rows(spark), L.METRIC_WEIGHTS)
    scores = L.boosted(L.text_scores(cases, "id", "nl_query", fields), cases, "id", "nl_query", G.BOOSTS)
    top = L.rank_topk(scores, "id", 1).select("id", "metric_id")
    linked = cases.join(top, "id", "left").withColumn("metric_id", F.coalesce("metric_id", F.lit("")))
    got = {r["id"]: r["decision"] for r in C.compile_requests(linked, C.contract_of(spark, CAT), CAT).collect()}
    wrong = []
    for i, (q, metric, dims) in enumerate(G.CASES):
        d = got[i]
        want = ("answer" if metric else "refuse", metric, sorted(dims.split()))
        if (d["action"], d["pred_metric_id"], sorted(d["pred_dimensions"])) != want:
            wrong.append((q, d["action"], d["pred_metric_id"], d["pred_dimensions"]))
    assert not wrong
    assert all(d["trace"]["checks"]["coverage"]["active"] for d in got.values())


def test_one_mutation_per_family(spark):
    patched = dict(next(m for m in G.METRICS if m["metric_id"] == "average_bottle_price"), metric_id="patched", formula="SUM(sales_dollars) / 1")
    cat = Catalog(metrics=G.METRICS + [patched], dimensions=G.DIMENSIONS, profile=G.PROFILE, schema_columns=G.COLUMNS)
    rows = [
        (None, "Average bottle price by category in 2024", "average_bottle_price", ["category_name"], None, None),
        ("field", "Unknown governed metric in 2024", "not_in_catalog", [], None, None),
        ("caliber", "Average bottle price in 2024", "patched", [], None, None),
        ("grain", "Store count by store name in 2024", "store_count", ["store_name"], None, None),
        ("coverage", "Average bottle price by category in 2024", "average_bottle_price", ["category_name"], None, ["sales_bottles"]),
        ("time", "Sales dollars in 2025", "sales_dollars", [], "2025", None),
        ("policy", "Show raw invoice ids in 2024", "invoice_count", [], None, None),
    ]
    df = spark.createDataFrame(rows, "want string, nl_query string, metric_id string, requested array<string>, time_binding string, coverage_remove array<string>")
    for r in C.compile_requests(df, C.contract_of(spark, cat), cat).collect():
        cert = r["decision"]["trace"]["certificate"]
        assert (cert["primary_failure"] if cert else None) == r["want"]
        assert not cert or cert["repairable"] == (cert["failed_constraints"] == ["grain"])


def test_isolation_of_metric_evidence(spark):
    def metric(i):
        return dict(metric_id=f"m{i}", scoped_ratio=True, numerator_nodes=[f"n{i}"], denominator_nodes=[f"d{i}"], coverage_nodes=[f"n{i}", f"d{i}"], domain_id="dom", formula="")

    edges = [dict(src=f"{s}{i}", dst=f"m{i}", edge_type=t, metric_id=f"m{i}", domain_id="dom") for i in (1, 2) for s, t in (("n", "numerator_of"), ("d", "denominator_of"))]
    bindings = [dict(binding_id=f"b{s}{i}", metric_id=f"m{i}", dependency_node_id=f"{s}{i}", physical_node_id=f"p{s}{i}", domain_id="dom") for i in (1, 2) for s in "nd"]
    coverage = [dict(coverage_id=f"c{s}{i}", semantic_node_id=f"p{s}{i}", domain_id="dom") for i in (1, 2) for s in "nd"]

    def first_failure(drop_edge=None, drop_node=None):
        m = rows_of(spark, [metric(1), metric(2)], METRIC_SCHEMA)
        e = rows_of(spark, [x for x in edges if not (x["metric_id"] == "m1" and x["edge_type"] == drop_edge)], EDGE_SCHEMA)
        b = rows_of(spark, [x for x in bindings if x["dependency_node_id"] != drop_node], BINDING_SCHEMA)
        c = C.metric_contract(m, e, b, rows_of(spark, coverage, COVERAGE_SCHEMA)).filter("metric_id = 'm1'").collect()[0]["contract"]
        return "caliber" if not c["caliber"]["passed"] else "coverage" if not c["coverage"]["passed"] else None

    assert first_failure() is None
    assert first_failure(drop_edge="numerator_of") == "caliber"
    assert first_failure(drop_edge="denominator_of") == "caliber"
    assert first_failure(drop_node="n1") == "coverage"
    assert first_failure(drop_node="d1") == "coverage"
