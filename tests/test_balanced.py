"""Equal numbers by draw order, and preference variants that share one collection."""

import hashlib

from pyspark.sql import functions as F

from plumbline.operators import curation as CU


def test_balanced_is_first_by_draw(spark):
    rows = [("a" if i % 3 else "b", f"k{i}") for i in range(900)]
    got = CU.balanced(spark.createDataFrame(rows, "label string, k string").withColumn("rank", F.lit(1)), "label", "k", "s")
    draw = lambda k: hashlib.md5(f"s|{k}".encode()).hexdigest()
    want = [(x, k) for x in "ab" for k in sorted((k for y, k in rows if y == x), key=lambda k: (draw(k), k))[:300]]
    assert got.columns == ["label", "k", "rank"] and sorted((r["label"], r["k"]) for r in got.collect()) == sorted(want)
    same = spark.createDataFrame([("a", "k")] * 5 + [("b", "k")] * 2, "label string, k string")
    assert CU.balanced(same, "label", "k", "s").groupBy("label").count().collect() == [("a", 2), ("b", 2)] or sorted(map(tuple, CU.balanced(same, "label", "k", "s").collect())) == [("a", "k")] * 2 + [("b", "k")] * 2


def test_variants_share_one_collection(spark):
    preds = spark.range(400).select((F.col("id") / 8).cast("long").alias("o"), (F.col("id") % 8).alias("beam"), F.lit("safe").alias("label"), F.when(F.col("id") % 3 > 0, "safe").otherwise("unsafe").alias("out"),
                                    (F.col("id") % 2 == 0).alias("same_result"), F.concat(F.lit("<sql_COT>"), F.col("id"), F.lit("</sql_COT>")).alias("text"))
    out = None
    for v in ("sql_wrong", "label_wrong", "any_wrong"):
        p = CU.preference_pairs(preds, "o", v, "x").withColumn("k", F.concat_ws("/", F.col("o").cast("string"), F.col("rank").cast("string")))
        b = CU.balanced(p, "label", "k", "y")
        out = b if out is None else out.unionByName(b)
    assert len(out.collect()) > 50
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("partial_collect_list") == 1 and "ReusedExchange" in plan
