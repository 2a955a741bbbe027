"""Distinct customers per dimension set, counted where the orders of a customer are."""

import random

from plumbline.plans import execute as E


def test_buyers_are_counted_in_place(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, *range(40)]), rnd.choice(["x", "y", None]), rnd.choice(["p", "q"])) for i in range(500)]
    heads = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, a string, b string")
    sets = [[], ["a"], ["a", "b"]]
    got = E.buyers(heads, {"a": "a", "b": "b"}, sets)
    want = {}
    for s in sets:
        for _, c, a, b in rows:
            want.setdefault(("|".join(s), "|".join({"a": a or "", "b": b}[d] for d in s)), set()).add(c)
    found = sorted((r["dims"], r["key"], r["value"], r["metric"]) for r in got.collect())
    assert found == sorted((d, k, float(len(c)), "customer_count") for (d, k), c in want.items())
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 2 and sum("o_custkey" in line for line in moved) == 1
    assert E.buyers(heads, {"a": "a"}, []).count() == 0
