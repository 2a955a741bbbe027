"""Bounded ranking against scores of every pair."""

import random

from pyspark.sql import functions as F

from plumbline.operators import linking as L, ranking as R

TEXT = "id int, t string"
FIELDS = "metric_id string, field string, weight double"


def plain(requests, fields, k, boosts, **kw):
    scores = L.text_scores(requests, "id", "t", fields, **kw)
    if boosts:
        scores = L.boosted(scores, requests, "id", "t", boosts)
    return {(r.id, r.metric_id, r.score, r["rank"]) for r in L.rank_topk(scores, "id", k).collect()}


def test_bounded_ranking_equals_full_ranking(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 5)))
    line = lambda n: " ".join(word() for _ in range(rng.randrange(1, n)))
    texts = [(i, line(9)) for i in range(80)] + [(80, None), (81, ""), (82, "  "), (83, "zzzz"), (84, "按 地区 统计 收入")]
    texts += [(100 + i, texts[i][1].upper() + " ") for i in range(20)]
    fields = [(f"m{i % 40}", line(4), rng.choice([0.5, 1.0, 2.5])) for i in range(160)] + [("m7", "收入", 2.5), ("tie_a", "aa b", 1.0), ("tie_b", "aa b", 1.0)]
    requests, catalog = spark.createDataFrame(texts, TEXT), spark.createDataFrame(fields, FIELDS)
    boosts = [("m3", ["ab", "c d"], 4.0), ("elsewhere", ["ee"], 9.0)]
    for k, cues, kw in ((1, (), {}), (3, boosts, {}), (5, (), dict(bigram=0.0)), (2, boosts, dict(phrase=4.0, bigram=0.1, blanks=True))):
        got = {(r.id, r.metric_id, r.score, r["rank"]) for r in R.best_targets(requests, "id", "t", catalog, k, boosts=cues, **kw).collect()}
        assert got == plain(requests, catalog, k, cues, **kw)
        once = L.ranked_texts(requests, "id", "t", catalog, k, cues, **kw).collect()
        assert got == {(r.id, r.metric_id, r.score, r["rank"]) for r in once}
    assert R.best_targets(requests, "id", "t", catalog.limit(0), 3).count() == 0
    assert R.best_targets(requests.limit(0), "id", "t", catalog, 3).count() == 0


def test_copies_of_a_catalog_are_not_scored(spark):
    """With 50 copies under other names, few of the pairs that share a term are scored."""
    names = ["total revenue", "order count", "units sold", "return share", "average unit price"]
    fields = [(f"{n}_{i}", f"distractor {i} {n}" if i else n, 3.0) for n in names for i in range(50)]
    texts = spark.createDataFrame([(i, f"what was the {names[i % 5]} in 199{i % 8}") for i in range(40)], TEXT)
    catalog = spark.createDataFrame(fields, FIELDS)
    u = texts.select(F.md5("t").alias("_u"), F.col("t").alias("_q"))
    index = R.postings(catalog, "metric_id", 5.0, 1.0, False)
    terms = R.text_terms(u, index, 1.0, False)
    shared = terms.join(index, "_k").select("_u", "metric_id").distinct().count()
    kept = R.bounded_pairs(terms, index, 1, "metric_id")
    assert shared > 9000 and kept.count() <= 40 * 3
    best = {r.id: r.metric_id for r in R.best_targets(texts, "id", "t", catalog, 1).collect()}
    assert best == {i: f"{names[i % 5]}_0" for i in range(40)}
