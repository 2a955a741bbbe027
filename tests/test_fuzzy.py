"""Fuzzy aliases: bounds and blocks against all pairs."""

import random

from plumbline.operators import linking as L


def ratio(a, b):
    """The whole similarity, by the definition."""
    if not a or not b:
        return 0.0
    both, left, right = " ".join(sorted(a & b)), " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if both and (not left or not right):
        return 100.0
    join = lambda x: " ".join(p for p in (both, x) if p)

    def one(x, y, common):
        return 100 * (1 - (len(x) + len(y) - 2 * common) / (len(x) + len(y))) if x or y else 0.0

    s, t = join(left), join(right)
    best = one(s, t, len(both) + (1 if both else 0) + L.common_length(left, right))
    if both:
        best = max(best, one(both, s, len(both)), one(both, t, len(both)))
    return best


def test_blocks_are_all_pairs(spark, monkeypatch):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcde收入") for _ in range(rnd.randint(1, 5)))
    phrase = lambda n: " ".join(word() for _ in range(rnd.randint(0, n)))
    texts = sorted({phrase(6) for _ in range(150)} | {"Abc, abc! d-e", "", "  "})
    aliases = [("m" if i % 3 else "d", f"i{i % 40}", phrase(3)) for i in range(200)] + [("m", "null", None)]
    words = L.alias_words
    want = {}
    for q in texts:
        scored = [(k, i, ratio(words(q), words(a)), len("".join(c if c.isalnum() or c == "_" else " " for c in a or "").lower().strip())) for k, i, a in aliases]
        top = min((-round(s, 9), -n, i) for k, i, s, n in scored if k == "m")
        want[q] = (top[2] if -top[0] >= 60 else "", round(-top[0], 6), sorted({i for k, i, s, _ in scored if k == "d" and s >= 85}))
    df, table = spark.createDataFrame([(q,) for q in texts * 2], "t string"), spark.createDataFrame(aliases, "kind string, id string, alias string")
    for inline in (512, 3):
        monkeypatch.setattr(L, "MAX_INLINE", inline)
        monkeypatch.setattr(L, "TEXT_BLOCK", 60)
        monkeypatch.setattr(L, "ALIAS_BLOCK", 50)
        got = L.fuzzy_links(df, "t", table).collect()
        assert len(got) == len(texts) and {r["t"]: (r["metric_id"], round(r["score"], 6), r["dimensions"]) for r in got} == want


def test_no_aliases_and_null_texts(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    none = spark.createDataFrame([], "kind string, id string, alias string")
    assert {tuple(r[:3]) for r in L.fuzzy_links(df, "t", none).collect()} == {("a", "", 0.0), (None, "", 0.0)}
