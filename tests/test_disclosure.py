"""Unqualified columns are given their tables."""

from plumbline.operators import disclosure as D


def test_small_schemas_need_no_second_reading(spark, monkeypatch):
    schema = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("b", "y"), (None, "z"), ("c", None)], "tbl string, col string")
    texts = ["select x, y from b join a on 1 = 1", "select x, y, z from a", "select q.y from b q where q.x = 3", "select z from c", "explain", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])]
    facts = D.extract_facts(spark.createDataFrame(rows, "pos long, sql string"))
    read = lambda df: sorted(map(repr, df.select("pos", "sql", "outs", "preds", "tables").collect()))
    inline = D.resolve_columns(facts, "pos", schema)
    assert "Join" not in inline._jdf.queryExecution().optimizedPlan().toString()
    got = {r.pos: [(o.tbl, o.col) for o in r.outs or []] for r in inline.filter("pos < 4").collect()}
    assert got == {0: [("b", "x"), ("b", "y")], 1: [("a", "x"), (None, "y"), (None, "z")], 2: [("b", "y")], 3: [(None, "z")]}
    monkeypatch.setattr(D, "MAX_INLINE", 0)
    assert read(inline) == read(D.resolve_columns(facts, "pos", schema))
    assert read(D.resolve_columns(facts, "pos", schema.limit(0))) == read(D.resolve_columns(facts, "pos", schema.filter("tbl = 'none'")))
