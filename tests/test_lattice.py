"""Cuboid lattices: which base a set is rolled up from, and equal results by every base."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from plumbline.operators import metrics as M

PARENTS = {"city": "land", "land": "zone", "month": "year"}


def test_bases_stay_below_their_share():
    sizes = {"city": 900, "land": 30, "zone": 5, "month": 80, "year": 7, "kind": 25, "shop": 50_000}
    sets = [list(s) for n in range(4) for s in combinations(sorted(sizes), n)]
    lattice = M.cuboids(sets, sizes, 100_000, PARENTS)
    assert sorted(s for own in lattice.values() for s in own) == sorted(sets)
    over = 0
    for base, own in lattice.items():
        assert all(set(s) <= base for s in own)
        n = 1
        for d in base - {a for d in base for a in M.ancestors_of(d, PARENTS)}:
            n *= sizes[d]
        over += n > 10_000
    # what is larger than a tenth of the fact by itself shares one base, everything else has a small one
    assert over == 1 and len(lattice) < 12
    home = {tuple(s): b for b, own in lattice.items() for s in own}
    assert "city" not in home["kind", "year"] or "shop" not in home["kind", "year"]


def test_parents_in_a_ring_end():
    assert M.ancestors_of("a", {"a": "b", "b": "a"}) == ["b", "a"]


def test_lattice_is_grouping_per_set(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(400):
        city = rnd.randint(0, 11)
        month = rnd.choice([None, *range(24)])
        rows.append((f"c{city}", f"l{city % 4}", f"z{city % 4 % 2}", month, None if month is None else month // 12, rnd.choice(["a", "a|b", "", None]), rnd.randint(1, 9)))
    cols = ["city", "land", "zone", "month", "year", "kind"]
    df = spark.createDataFrame(rows, "city string, land string, zone string, month int, year int, kind string, v long")
    sets = [list(s) for n in range(4) for s in combinations(cols, n)]
    want = {}
    for s in sets:
        for r in rows:
            at = tuple(r[cols.index(d)] for d in sorted(s))
            k = "|".join(sorted(s)), at
            want[k] = want.get(k, 0) + r[-1]
    want = sorted((d, "|".join("" if x is None else str(x) for x in at), v) for (d, at), v in want.items())
    for share in (0.0, 0.1, 1.0):
        got = M.grouping_sets(df, {c: c for c in cols}, sets, [("v", F.col("v"))], PARENTS, share)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert M.grouping_sets(df, {c: c for c in cols}, [[]], [("v", F.col("v"))]).collect()[0]["v"] == sum(r[-1] for r in rows)
    assert M.grouping_sets(df.limit(0), {c: c for c in cols}, [["city"]], [("v", F.col("v"))]).count() == 0


def test_sets_with_a_large_dimension_move_the_fact_once(spark, monkeypatch):
    monkeypatch.setattr(M, "GROUPS_IN_TASK", 2000)
    df = spark.range(3000).select((F.col("id") % 1500).cast("string").alias("buyer"), (F.col("id") % 7).cast("string").alias("a"), (F.col("id") % 11).cast("string").alias("b"), F.when(F.col("id") % 13 > 0, "x").alias("c"), F.col("id").alias("v"))
    sets = [["buyer", "a"], ["buyer", "b"], ["buyer", "c"], ["buyer", "a", "b"], ["a"], ["b", "c"]]
    got = M.grouping_sets(df, {c: c for c in ("a", "b", "c", "buyer")}, sets, [("v", F.col("v"))])
    want = []
    for s in sets:
        s = sorted(s)
        want += [("|".join(s), "|".join("" if r[d] is None else r[d] for d in s), r["v"]) for r in df.groupBy(*s).agg(F.sum("v").alias("v")).collect()]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    # the fact by its buyer, and the two small sets by base and by set
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("Exchange hashpartitioning(buyer") == 1
