"""Connected components by star contraction, for links that no machine could hold."""

from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import durable, join_groups


def _stars(pairs: DataFrame, larger: bool) -> DataFrame:
    """One star step over pairs (a, b): every node hands its smallest neighbour to its larger, or its smaller ones."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else pairs
    total = both.count()
    least = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    met = join_groups(both, least, ["a"], total)
    if larger:
        moved = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(met.select("a", F.col("m").alias("b")))
    return moved.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of links (a, b) the smallest node that it reaches; nodes are whole numbers.

    Large-star and small-star steps until nothing moves; the number of steps grows with the logarithm of the nodes.
    """
    pairs = durable(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    state = None
    while True:
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == state or not now.n:
            break
        state = now
        pairs = durable(_stars(durable(_stars(pairs, larger=True)), larger=False))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
