"""Best targets of texts by weighted overlap, without scoring every pair that shares a term."""

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions import text as X
from plumbline.operators import filters as P, scale
from plumbline.session import checkpointed

#: Terms of a text whose best targets set its first threshold. Any number gives the same result.
SEED_TERMS = 6
#: Share of the threshold that unopened terms may add up to: less opens more posting lists and leaves fewer pairs to score.
UNOPENED = 0.25
#: Scores are rounded to six places; bounds leave room for it.
MARGIN = 1e-5


def postings(fields: DataFrame, target, phrase, bigram, blanks, boosts=()) -> DataFrame:
    """(target, _k, _s): what each target gains when a text has the term: a whole field, a word, a character pair, a cue."""
    scored = lambda mark, xs, s: F.transform(xs, lambda x: F.struct(F.concat(F.lit(mark), x).alias("k"), s.alias("s")))
    parts = [scored("p:", F.array("field"), F.lit(float(phrase))), scored("w:", X.tokens(F.col("field")), F.lit(1.0))]
    if bigram:
        pairs = X.bigrams(F.col("field"), blanks)
        parts.append(scored("b:", pairs, F.lit(float(bigram)) / F.sqrt(F.size(pairs))))
    rows = fields.select(target, "weight", F.explode(F.concat(*parts)).alias("x")).select(target, F.col("x.k").alias("_k"), (F.col("weight") * F.col("x.s")).alias("_s"))
    if boosts:
        cues = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(f"c:{i}").alias("k"), F.lit(float(x)).alias("s")) for i, (m, _, x) in enumerate(boosts)])
        one = fields.sparkSession.range(1).select(F.explode(cues).alias("x"))
        rows = rows.unionByName(one.select(F.col("x.m").alias(target), F.col("x.k").alias("_k"), F.col("x.s").alias("_s")))
    return rows.groupBy(target, "_k").agg(F.sum("_s").alias("_s"))


def text_terms(texts: DataFrame, index: DataFrame, bigram, blanks, boosts=()) -> DataFrame:
    """(_u, _k): the terms of each text that the index has; whole fields are found through their rarest gram."""
    mark = lambda m, xs: F.transform(xs, lambda x: F.concat(F.lit(m), x))
    parts = [mark("w:", X.tokens(F.col("_q")))] + ([mark("b:", X.bigrams(F.col("_q"), blanks))] if bigram else [])
    parts += [F.when(P.contains_any(F.col("_q"), terms), F.array(F.lit(f"c:{i}"))).otherwise(F.array().cast("array<string>")) for i, (_, terms, _) in enumerate(boosts)]
    rows = texts.select("_u", F.explode(F.concat(*parts)).alias("_k"))
    known = index.select("_k").distinct()
    fields = known.filter(F.col("_k").startswith("p:")).select(F.expr("substr(_k, 3)").alias("field"))
    whole = P.substring_join(texts, "_u", "_q", fields, "field")
    return rows.join(known, "_k", "left_semi").unionByName(whole.select("_u", F.concat(F.lit("p:"), "field").alias("_k")))


def scored_pairs(pairs: DataFrame, terms: DataFrame, index: DataFrame, target) -> DataFrame:
    """(_u, target, score) of the given pairs: each meets the terms of its text and the postings of its target in one row."""
    have = terms.groupBy("_u").agg(F.collect_set("_k").alias("_have"))
    gains = index.groupBy(target).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_s"))).alias("_gains"))
    both = F.array_intersect("_have", F.map_keys("_gains"))
    score = F.aggregate(F.array_sort(both), F.lit(0.0), lambda a, k: a + F.element_at("_gains", k))
    return pairs.join(have, "_u").join(gains, target).select("_u", target, F.round(score, 6).alias("score"))


def bounded_pairs(terms: DataFrame, index: DataFrame, k, target) -> DataFrame:
    """(_u, target) pairs that may be among the k best of their text.

    A threshold comes from whole scores of a few promising targets: the k-th best of them, so the text's k-th best is no
    lower. Terms whose largest gains together stay below a share of it cannot carry a target alone; only the others open
    their posting lists, and a target stays if its part score and all that the left-out terms may add reach the threshold.
    """
    most = index.groupBy("_k").agg(F.max("_s").alias("_ub"))
    t = terms.join(most, "_k")
    best = scale.first_k(index, ["_k"], [F.desc("_s"), F.desc(target)], k, "_r").select("_k", target)
    seeds = scale.first_k(t, ["_u"], [F.desc("_ub"), "_k"], SEED_TERMS, "_r").select("_u", "_k").join(best, "_k").select("_u", target).distinct()
    sure = scale.first_k(scored_pairs(seeds, terms, index, target), ["_u"], [F.desc("score"), F.desc(target)], k, "_r")
    floor = sure.filter(F.col("_r") == k).select("_u", F.col("score").alias("_floor"))
    upto = W.partitionBy("_u").orderBy("_ub", "_k").rowsBetween(W.unboundedPreceding, W.currentRow)
    opened = F.col("_sum") >= UNOPENED * F.col("_floor")
    b = t.join(floor, "_u", "left").withColumn("_floor", F.coalesce("_floor", F.lit(0.0)) - MARGIN).withColumn("_sum", F.sum("_ub").over(upto))
    b = b.withColumn("_rest", F.coalesce(F.max(F.when(~opened, F.col("_sum"))).over(W.partitionBy("_u")), F.lit(0.0)))
    # few rows open long lists
    part = scale.spread(b.filter(opened).select("_u", "_k", "_floor", "_rest"), "_k").join(scale.spread(index, "_k"), "_k")
    part = part.groupBy("_u", target).agg(F.sum("_s").alias("_part"), F.first("_floor").alias("_floor"), F.first("_rest").alias("_rest"))
    return part.filter(F.col("_part") + F.col("_rest") >= F.col("_floor")).select("_u", target)


def best_targets(requests: DataFrame, key, text, fields: DataFrame, k, target="metric_id", phrase=5.0, bigram=1.0, blanks=False, boosts=()) -> DataFrame:
    """(key, target, score, rank) of the k best targets with a positive score; ties go to the larger id.

    Equals `rank_topk(boosted(text_scores(...)))` for weights and boosts that are not negative. Equal texts are ranked once.
    A text that is null has no targets.
    """
    asked = requests.select(key, F.lower(F.trim(text)).alias("_q")).withColumn("_u", F.md5("_q"))
    # all three are read several times below
    texts = checkpointed(asked.filter("_q IS NOT NULL").select("_u", "_q").distinct())
    index = checkpointed(postings(fields, target, phrase, bigram, blanks, boosts))
    terms = checkpointed(text_terms(texts, index, bigram, blanks, boosts))
    scores = scored_pairs(bounded_pairs(terms, index, k, target), terms, index, target)
    top = scale.first_k(scores.filter("score > 0"), ["_u"], [F.desc("score"), F.desc(target)], k)
    return asked.select(key, "_u").join(top, "_u").select(key, target, "score", "rank")
