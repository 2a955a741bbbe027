"""Labels that contain others, against all pairs."""

import random

from pyspark.sql import functions as F

from plumbline.operators import joins as JN


def test_contained_labels_are_all_pairs(spark):
    rnd = random.Random(8)
    rows = {(rnd.choice(["d1", "d2"]), "".join(rnd.choice("ab_x\u00e9") for _ in range(rnd.randint(0, 12)))) for _ in range(300)}
    rows |= {("d3", "x" * 300), ("d3", "x" * 290), ("d3", "y" + "x" * 300), ("d3", "y")}
    got = JN.contained_labels(spark.createDataFrame(sorted(rows), "db string, label string"), ["db"], "label").collect()
    want = {(d, a, b) for d, a in rows for e, b in rows if d == e and b and b in a}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_long_labels_bring_rows_by_their_characters(spark):
    labels = spark.createDataFrame([("d", f"{i}_" + "".join(random.Random(i).choice("abcdefgh") for _ in range(2000))) for i in range(200)], "db string, label string")
    assert JN.contained_labels(labels, ["db"], "label").filter(F.col("label") == F.col("_part")).count() == 200


def test_long_names_are_related(spark):
    name = "n" * 280 + "_id"
    cols = spark.createDataFrame(
        [("d", "a", 1, name, "int", True, True), ("d", "b", 2, "z" + name, "int", False, True), ("d", "c", 3, name, "text", False, True)],
        "db string, tbl string, seq int, col string, type string, is_pk boolean, sole_pk boolean")
    links = spark.createDataFrame([], "db string, pk_tbl string, fk_tbl string, fk_col string")
    got = JN.relationships(cols, links).select("db", "pk_tbl", "pk_col", "fk_tbl", "fk_col")
    assert [tuple(r) for r in got.collect()] == [("d", "a", name, "b", "z" + name)]


def test_pairs_stream_and_come_once(spark, monkeypatch):
    monkeypatch.setattr(JN, "PAIR_BLOCK", 3)
    rnd = random.Random(4)
    rows = [(rnd.choice("de"), f"t{rnd.randint(0, 7)}", rnd.randint(1, 6), rnd.choice(["id", "t1_id", "xt1_id", "code", "Code"]), rnd.choice(["int", "text"]), rnd.random() < 0.4, rnd.random() < 0.6) for _ in range(200)]
    links = {(rnd.choice("de"), f"t{rnd.randint(0, 7)}", f"t{rnd.randint(0, 7)}", rnd.choice(["t1_id", "code", "id"])) for _ in range(40)}
    cols = spark.createDataFrame(rows + rows[:20], "db string, tbl string, seq int, col string, type string, is_pk boolean, sole_pk boolean")
    df = JN.relationships(cols, spark.createDataFrame(sorted(links), "db string, pk_tbl string, fk_tbl string, fk_col string"))
    want = set()
    name = lambda r: r[1] + "_id" if r[3].lower() == "id" else r[3].lower()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[4] == b[4] and name(b) in name(a) and a[1] != b[1] and not (a[5] and a[6] and b[5] and b[6]) and (a[5] or b[5]):
                pk, fk = (a, b) if (a[2] < b[2] if a[5] and b[5] else a[5]) else (b, a)
                if (a[0], pk[1], fk[1], fk[3]) not in links:
                    want.add((a[0], pk[1], pk[3], fk[1], fk[3]))
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want
    # no aggregate or join above the pairs of columns that are listed one way
    assert df._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
