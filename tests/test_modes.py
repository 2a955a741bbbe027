"""Modes are linked once per distinct text, and name the same metrics as scores of every request."""

from pyspark.sql import functions as F

from plumbline.operators import linking as L
from plumbline.plans.governed import catalog
from plumbline.queries import QUERIES, load

TEXTS = ["Revenue by region", " revenue by region ", "units per brand", "return share", "", None, "zzz"]


def test_best_of_a_text_is_that_of_its_requests(spark):
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "id int, t string").withColumn("u", F.lower(F.trim("t")))
    for weights in (L.METRIC_WEIGHTS, L.DIRECT_WEIGHTS):
        fields = L.field_rows(catalog().metric_rows(spark), weights)
        texts = asked.select("u").filter("u IS NOT NULL").distinct()
        got = {r[0]: r[1] for r in asked.join(L.text_best(texts, "u", "u", fields), "u").select("id", "metric_id").collect()}
        each = L.text_scores(asked, "id", "t", fields).groupBy("id").agg(F.max_by("metric_id", F.struct("score", "metric_id")))
        assert got == {r[0]: r[1] for r in each.collect()} and got[0] == got[1] == got[7] == "revenue"


def test_modes_score_distinct_texts(spark, tmp_path):
    load()
    rows = [(i, i) for i in [*range(1, 400), 24, 24]]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    made = QUERIES["lk_mode_predict"](spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    scored = [line for line in plan.splitlines() if "sum(_s" in line]
    assert len(scored) == 2 and not any("request_id" in line for line in scored), scored
    assert made.filter("request_id = 24").count() == 5 * 9 and made.count() == 5 * (398 + 9)
