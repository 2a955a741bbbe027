"""Result comparison within a tolerance against a plain greedy version."""

import random

from plumbline.operators import results as RC

SCHEMA = "instance string, candidate int, row_no long, col string, value string"


def number(v):
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def same_column(a, b, ordered=False, tol=RC.TOLERANCE):
    order = (lambda v: v) if ordered else (lambda v: sorted(v, key=lambda x: (x is None, number(x) is not None, number(x) or 0, str(x))))
    a, b = order(a), order(b)
    if len(a) != len(b):
        return False
    for x, y in zip(a, b):
        m, n = number(x), number(y)
        if (m is None) != (n is None) or (abs(m - n) > tol if m is not None else x != y):
            return False
    return True


def covers(offered, wanted, **kw):
    return all(any(same_column(w, o, **kw) for o in offered) for w in wanted)


def greedy(results):
    heads, out = [], {}
    for c in sorted(results):
        out[c] = next((h for h in heads if covers(results[c], results[h])), None)
        if out[c] is None:
            out[c] = c
            heads.append(c)
    return out


def table(rng):
    n = rng.randrange(1, 5)
    return [[rng.choice([None, "x", "y", "1.000", "2.004", "0.0", "-3.5"]) for _ in range(n)] for _ in range(rng.randrange(1, 4))]


def nudged(rng, t):
    rows = list(range(len(t[0])))
    rng.shuffle(rows)
    step = rng.choice([0.0, 0.004, 0.009, 0.012])
    out = [[c[i] if number(c[i]) is None else f"{number(c[i]) + step:.3f}" for i in rows] for c in t]
    if rng.random() < 0.3:
        out.append(["extra"] * len(rows))
    if rng.random() < 0.2 and len(out) > 1:
        out.pop(0)
    return out


def cells(instance, results):
    return [(instance, c, i, f"c{k}_{c}", v) for c, t in results.items() for k, col in enumerate(t) for i, v in enumerate(col)]


def made(seed, n):
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        base = table(rng)
        out[f"i{i}"] = {c: base if rng.random() < 0.2 else nudged(rng, base) if rng.random() < 0.8 else table(rng) for c in range(rng.randrange(1, 7))}
    # values that straddle a rounding edge, a chain whose ends are apart, an empty text against a null
    out["edge"] = {0: [["1.049", "2"]], 1: [["1.051", "2"]], 2: [["1.058", "2"]], 3: [["1.060", "2"]]}
    out["void"] = {0: [[None, ""]], 1: [["", None]], 2: [["", ""]]}
    return out


def test_clusters_are_the_greedy_ones(spark):
    instances = made(1, 60)
    got = RC.clusters(spark.createDataFrame([r for i, t in instances.items() for r in cells(i, t)], SCHEMA)).collect()
    want = {(i, c): h for i, t in instances.items() for c, h in greedy(t).items()}
    assert {(r.instance, r.candidate): r.cluster for r in got} == want
    assert all(r["size"] == sum(h == r.cluster for (i, _), h in want.items() if i == r.instance) for r in got)


def test_column_match_is_the_plain_one(spark):
    instances = made(2, 40)
    gold = {i: t[0] for i, t in instances.items()}
    pred = spark.createDataFrame([r for i, t in instances.items() for r in cells(i, t)] + [("lone", 1, 0, "a", "1")], SCHEMA)
    golden = spark.createDataFrame([(i, k, f"g{n}", v) for i, t in gold.items() for n, col in enumerate(t) for k, v in enumerate(col)], "instance string, row_no long, col string, value string")
    for ordered in (False, True):
        got = {(r.instance, r.candidate): r.match for r in RC.column_match(pred, golden, ordered).collect()}
        assert got == {(i, c): covers(t, gold[i], ordered=ordered) for i, ts in instances.items() for c, t in ts.items()}


def test_table_equal_aligns_by_name_then_content(spark):
    gold = spark.createDataFrame([("a", r, c, v) for r, (x, y) in enumerate([("1", "u"), ("2", None), ("2", None)]) for c, v in (("n", x), ("t", y))], "instance string, row_no long, col string, value string")
    tables = {0: [("1", "u"), ("2", None), ("2", None)], 1: [("2", None), ("1", "u"), ("2", None)], 2: [("2", "u"), ("1", None), ("2", None)], 3: [("1", "u"), ("2", None)], 4: [("1", "u"), ("2", None), ("1", "u")]}
    rows = [("a", k, r, c, v) for k, t in tables.items() for r, (x, y) in enumerate(t) for c, v in ((("n", x), ("t", y)) if k != 1 else (("p", x), ("q", y)))]
    got = {r.candidate: r.equal for r in RC.table_equal(spark.createDataFrame(rows, SCHEMA), gold).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False}
