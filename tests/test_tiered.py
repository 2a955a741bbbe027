"""Tiered matches against all pairs, and what their plan shuffles."""

import re

from pyspark.sql import functions as F

from plumbline.operators import joins as JN


def windows(name):
    parts = name.lower().split(".")
    return {".".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1)}


def tables(spark):
    wanted = [(1, "A", "t_1"), (2, "a", "t_9"), (3, "a", "none"), (4, "b", "x.t_1"), (5, "zz", "t_1"), (None, "a", "t_1"),
              (6, "a", "t_1"), (6, "a", "p.t_1"), (6, "a", "t_1"), (7, "a", "t_8"), (7, "a", "p.t_7"), (8, "a", "no"), (8, "a", "where"), (9, "a", None), (10, "a", "t_1"), (10, "b", "lost")]
    catalog = [("P.t_1", "a", 1), ("P.t_1", "A", 2), ("P.t_2", "a", 3), ("P.t_3", "b", 4), ("q.x.T_1", "b", 5), ("p.t_4", "a", 6), ("p.t_1", "a", 7), ("P.t_1", "a", 1)]
    return wanted, catalog, spark.createDataFrame(wanted, "k long, col string, tbl string"), spark.createDataFrame(catalog, "tbl string, col string, pos long")


def test_tiers_are_all_pairs(spark):
    wanted, catalog, w, c = tables(spark)
    mask = lambda x: re.sub(r"\*+", "*", re.sub("[0-9]", "*", x))
    found = lambda k, f: {(k, t, col, p) for kk, wc, wt in wanted if kk == k and wt is not None for t, col, p in catalog if col.lower() == wc.lower() and f(wt.lower()) in {f(x) for x in windows(t)}}
    want = []
    for k in {k for k, _, _ in wanted if k is not None}:
        rows = found(k, lambda x: x), found(k, mask)
        tier = 1 if rows[0] else 2 if rows[1] else 3
        if tier == 3:
            few = {c: sorted((p, t, col) for t, col, p in catalog if col.lower() == c)[:2] for c in ("a", "b", "zz")}
            want += {(k, t, col, p, 3) for kk, wc, _ in wanted if kk == k for p, t, col in few[wc.lower()]}
        else:
            want += [(*r, tier) for r in rows[tier - 1]]
    got = [tuple(r) for r in JN.tiered_match(w, "k", c, "pos", 2).filter("k is not null").collect()]
    assert sorted(got) == sorted(want) and len(set(got)) == len(got) and {r[-1] for r in got} == {1, 2, 3}


def test_windows_are_not_broadcast(spark):
    w = spark.sql("SELECT * FROM VALUES (1L, 'a', 't_1') AS v(k, col, tbl)")
    c = spark.sql("SELECT * FROM VALUES ('P.t_1', 'a', 1L) AS v(tbl, col, pos)")
    got = JN.tiered_match(w.filter("k > 0"), "k", c.filter("pos > 0"), "pos")
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"SortMergeJoin \[_c#\d+, _t#\d+\]", plan) and not re.search(r"BroadcastHashJoin \[_c#\d+, _t#\d+\]", plan)


def test_blocks_of_a_common_name_are_all_pairs_on_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(JN, "TIER_BLOCK", 16, raising=False)
    rows = [(f"Proj.t_{i % 7}", "aA"[i % 2], None if i % 50 == 3 else i) for i in range(200)]
    wishes = [(None if i == 9 else i, "A", "t_*" if i % 2 else "T_99") for i in range(300)] + [(i, "a", "proj.t_8") for i in range(40)] + [(i, "a", "t_3") for i in range(4)]
    w = spark.createDataFrame(wishes, "k long, col string, tbl string").repartition(4)
    c = spark.createDataFrame(rows, "tbl string, col string, pos long").repartition(4)
    got = JN.tiered_match(w, "k", c, "pos").withColumn("part", F.spark_partition_id())
    want = {(k, *r, 1) for k in range(4) for r in rows if r[0] == "Proj.t_3"} | {(k, *r, 2) for k in [*range(4, 300), None] for r in rows}
    found = [tuple(r) for r in got.drop("part").filter("tier < 3").collect()]
    assert set(found) == want and len(found) == len(want)
    held = [r["count"] for r in got.groupBy("part").count().collect()]
    assert max(held) < sum(held) / 3
