"""Terms found in texts through their rarest gram, against plain search."""

import random

from plumbline.operators import filters as P


def test_substring_join_finds_what_contains_finds(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcd 店é") for _ in range(n))
    texts = [(i, word(rng.randrange(0, 300))) for i in range(60)] + [(60, None), (61, "")]
    terms = [(f"p{i}", word(rng.randrange(0, 9))) for i in range(400)] + [("own", texts[3][1]), ("none", "zzzz"), ("part", "zzzzabcd"), ("null", None)]
    got = {(r.id, r.pid, r.term) for r in P.substring_join(spark.createDataFrame(texts, "id int, t string"), "id", "t", spark.createDataFrame(terms, "pid string, term string")).collect()}
    assert got == {(i, p, w) for i, t in texts for p, w in terms if t and w and w in t}
    empty = spark.createDataFrame([], "pid string, term string")
    assert P.substring_join(spark.createDataFrame(texts, "id int, t string"), "id", "t", empty).count() == 0


def test_many_terms_meet_few_texts(spark):
    """20,000 terms that share a beginning: each meets the texts that have its own rare part."""
    texts = spark.createDataFrame([(i, f"please show account number {i:06d} of the customer") for i in range(500)], "id int, t string")
    terms = spark.createDataFrame([(f"account number {i:06d}",) for i in range(0, 400_000, 20)], "term string")
    got = {(r.id, r.term) for r in P.substring_join(texts, "id", "t", terms, gram=8).collect()}
    assert got == {(i, f"account number {i:06d}") for i in range(0, 500, 20)}
