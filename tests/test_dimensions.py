"""Both forms of the dimension rules agree; the decision trace is whole; coverage can be overridden in every mode."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import contract as C, dimensions as D, filters as P
from plumbline.plans.governed import DIMENSIONS, METRICS, POLICIES, catalog
from plumbline.queries import ct_wide
from plumbline.sources.catalog import Catalog

CAT = catalog()
# Awkward dimensions: a domain of their own, a cycle, an alias that is no plain word, one without an expression.
AWKWARD = Catalog(**{**CAT.__dict__, "dimensions": DIMENSIONS + [
    dict(dimension_id="loop_a", name="Loop A", aliases=["a/b test"], parent="loop_b", grain_rank=1, sql="p_brand || x_one"),
    dict(dimension_id="loop_b", name="", aliases=[], parent="loop_a", grain_rank=1, sql=None),
    dict(dimension_id="shop", name="Shop Floor", aliases=["shop", "店"], parent="nobody", grain_rank=None, sql="s_name", domain_id="retail"),
]})
TEXTS = [
    ("revenue by region and country", "revenue"), ("units per shop floor", "units"), ("units by a/b test", "units"), ("orders by loop b, brand", "order_count"),
    ("Monthly revenue", "revenue"), ("按地区统计营收", "revenue"), ("revenue", "revenue"), ("", "units"), (None, "units"), ("revenue by month and year in 1997", "ghost"),
    ("return share by customer", "return_share"), ("revenue by xregion", "revenue"), ("revenue by region", None), ("drop table by region", "units"),
]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(i, q, m) for i, (q, m) in enumerate(TEXTS * 2)], "id int, nl_query string, metric_id string")


@pytest.mark.parametrize("cat", [CAT, AWKWARD], ids=["governed", "awkward"])
def test_forms_decide_alike(spark, asked, cat):
    contract = C.contract_of(spark, cat)
    given = asked.withColumn("requested", F.when(F.col("id") % 3 == 0, F.array(F.lit("region"), F.lit("planet"), F.lit("nation"), F.lit("region"))).when(F.col("id") % 3 == 1, F.array().cast("array<string>")))
    for requests in (asked, given, given.withColumn("coverage_remove", F.array(F.lit("R_NAME")))):
        inline, joined = (rows(C.compile_requests(requests, contract, cat, form=f)) for f in ("inline", "joined"))
        assert inline == joined and len(inline) == len(TEXTS) * 2


def test_forms_validate_alike(spark, asked):
    plans = asked.filter("metric_id IS NOT NULL").select("id", "nl_query", F.lit("answer").alias("action"), F.col("metric_id").alias("pred_metric_id"), F.lit("ok").alias("parse_status"),
                         F.when(F.col("id") % 2 == 0, F.array(*map(F.lit, ["region", "customer", "planet", "loop_a"]))).otherwise(F.array(F.lit("month"))).alias("pred_dimensions"))
    for cat in (CAT, AWKWARD):
        args = plans, C.contract_of(spark, cat), cat, P.trigger_rows(POLICIES, strip=False), ["profit_margin"]
        inline, joined = (rows(C.validate_plans(*args, form=f)) for f in ("inline", "joined"))
        assert inline == joined
    kinds = {v["type"] for r in inline for v in r[-1]}
    assert {"finest_grain_violation", "dimension_not_allowed"} <= kinds
    for fn in (lambda f: C.conformance(plans, args[1], AWKWARD, form=f), lambda f: C.posthoc_baselines(plans.withColumn("mode", F.lit("m")).withColumn("reason", F.lit("")), AWKWARD, F.lit(False), form=f)):
        assert rows(fn("inline")) == rows(fn("joined"))


def test_dimension_tables_agree(spark):
    """The table made of a DataFrame by path doubling is the one made of the lists."""
    lists = D.table(spark, AWKWARD)
    frame = D.table_of(AWKWARD.dimension_rows(spark).withColumn("sql", F.coalesce("sql", F.lit(""))), tuple(D.X.SQL_WORDS + AWKWARD.extra_sql_words))
    same = lambda df: rows(df.select("dimension_id", "grain_rank", "domain_id", F.sort_array("ancestors"), F.sort_array("fields")))
    assert same(lists) == same(frame)


def test_wide_catalog_takes_the_joined_form(spark):
    assert not D.inline(ct_wide.WIDE) and len(ct_wide.WIDE.dimensions) == 2400 and len(ct_wide.WIDE.metrics) == 1800
    asked = spark.createDataFrame([(1, "revenue by country 7, region 7 and brand 9", "revenue_7"), (2, "revenue by country 7", "revenue")], "id int, nl_query string, metric_id string")
    got = {r.id: r.decision for r in C.compile_requests(asked, C.contract_of(spark, ct_wide.WIDE), ct_wide.WIDE).collect()}
    assert got[1].trace.checks.grain.resolved_finest == ["brand", "brand_9", "nation", "nation_7"]
    assert got[1].trace.checks.grain.removed_ancestors == ["region", "region_7"] and got[1].trace.checks.grain.disallowed == ["brand_9"]
    assert got[2].reason == "constraint_failure:grain" and got[2].trace.certificate.repairable


def test_trace_is_whole(spark):
    asked = spark.createDataFrame([("average order value by region", "average_order_value", ["average_order_value", "revenue"], None), ("units by brand", "units", None, ["L_QUANTITY", "p_brand"]), ("units by brand", "units", [], ["p_brand"])],
                                  "nl_query string, metric_id string, candidate_metrics array<string>, coverage_override array<string>")
    free = Catalog(**{**CAT.__dict__, "schema_columns": []})
    for cat, mode in ((CAT, "physical_schema_columns"), (free, "not_available_in_released_contract")):
        first, covered, lacking = [r.decision for r in C.compile_requests(asked, C.contract_of(spark, cat), cat, disabled=("time",)).collect()]
        assert first.trace.candidate_metrics == ["average_order_value", "revenue"] and covered.trace.candidate_metrics == [] == lacking.trace.candidate_metrics
        checks = first.trace.checks
        assert checks.field.metric_id == checks.caliber.metric_id == "average_order_value"
        assert checks.caliber.required_numerator == [] and checks.coverage.missing_bindings == [] == checks.coverage.missing_physical_assets
        assert checks.time.disabled_for_ablation and checks.time.passed and not checks.policy.disabled_for_ablation
        assert checks.coverage.mode == mode and checks.coverage.required == ["l_discount", "l_extendedprice", "o_orderkey", "r_name"]
        assert covered.action == "answer" and covered.trace.checks.coverage.mode == "explicit_override"
        assert lacking.reason == "constraint_failure:coverage" and lacking.trace.checks.coverage.missing == ["l_quantity"]


def test_aliases_meet_by_their_rarest_word(spark):
    from plumbline.operators import joins as J

    names = spark.createDataFrame([(f"distractor {i} region",) for i in range(300)] + [("region",)], "alias string")
    texts = spark.createDataFrame([(1, "show distractor 17 region now"), (2, "distractor x"), (3, "region")], "id int, t string")
    hits = J.alias_join(texts, "id", "t", names)
    assert rows(hits) == [(1, "distractor 17 region"), (1, "region"), (3, "region")]
