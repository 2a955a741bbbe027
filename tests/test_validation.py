"""Plans are validated by expressions that occur once: triggers are looked for once, and no rule is evaluated inside a lambda."""

from pyspark.sql import functions as F

from plumbline.operators import contract as C, filters as P
from plumbline.plans.governed import POLICIES, catalog

CAT = catalog()
PLANS = [
    (1, "revenue by region", "answer", "revenue", ["region"], "ok"),
    (2, "drop table by weather", "answer", "revenue", ["region", "planet"], "ok"),
    (3, None, "answer", "ghost", None, "ok"),
    (4, "revenue by nation", "answer", "revenue", ["region", "nation"], "ok"),
    (5, "weather by region", "refuse", "", [], "ok"),
    (6, "revenue by region", "refuse", "", [], "ok"),
    (7, "", "answer", "", [], "ok"),
    (8, "", "answer", "", [], "missing"),
    (9, "show me the numbers", "answer", "profit_margin", [], "ok"),
]


def test_triggers_are_looked_for_once(spark):
    plans = spark.createDataFrame(PLANS, "id int, nl_query string, action string, pred_metric_id string, pred_dimensions array<string>, parse_status string").repartition(2)
    got = C.validate_plans(plans, C.contract_of(spark, CAT), CAT, P.trigger_rows(POLICIES, strip=False), ["profit_margin"]).select("id", "violations")
    found = {r["id"]: [tuple(v) for v in r["violations"]] for r in got.collect()}
    assert found[1] == found[5] == [] and found[6] == [("unjustified_refusal", "")] and found[8] == [("output_not_parseable", "missing")]
    assert found[2] == [("dimension_not_in_catalog", "planet"), ("missed_refusal", "drop ,weather")]
    assert found[3] == [("metric_not_in_catalog", "ghost")] and found[7] == [("answer_without_metric", "")]
    assert found[4] == [("finest_grain_violation", "region>nation")]
    assert found[9] == [("unanswerable_metric", "profit_margin"), ("missed_refusal", "policy")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # once as a trigger of the plan, twice among the cases of the policy check (any of them, and the checks' flag)
    assert plan.count("weather") <= 8 and "filter(array(" not in plan, plan.count("weather")
