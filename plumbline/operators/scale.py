"""Helpers that keep results exact when one key holds much of the data."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F


#: Session setting: partitions to deal the rows of single-file tables into.
DEAL = "spark.plumbline.deal"


def spread(df: DataFrame, key) -> DataFrame:
    """Rows dealt into the partitions that the session asks for by DEAL, before CPU-heavy column work.

    For tables of one file with one row group, as in the local bench; unset, as on a cluster, nothing is shuffled.
    """
    parts = df.sparkSession.conf.get(DEAL, None)
    return df.repartition(int(parts), key) if parts else df


def fenced(df: DataFrame, *cols) -> DataFrame:
    """Compute the given columns once: filters on them are not rewritten into what they were made of.

    Without it a filter on a decision would be pushed through every step below and repeat their expressions.
    """
    keep = [c for c in df.columns if c not in cols]
    one = F.explode(F.array(F.struct(*cols))).alias("_x")
    return df.select(*keep, one).select(*keep, *[F.col(f"_x.{c}").alias(c) for c in cols])


def draw_key(seed, key) -> Column:
    """Order of a reproducible draw: md5 of seed and key, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string") if isinstance(key, str) else key))


def draw_bucket(draw) -> Column:
    """Order-preserving coarse bucket of a draw key, 65,536 of them."""
    return F.substring(draw, 1, 4)


def positions(df: DataFrame, order, bucket, keys=(), name="pos") -> DataFrame:
    """Exact 1-based position of every row by `order` within `keys`, without one task holding a group.

    `bucket` orders the same way as `order`, coarser: one column, or a (coarse, fine) pair where one column would
    have too many values. Rows are ranked inside their bucket and shifted by the counts of the buckets before it;
    those are summed inside the coarse bucket first, so the last running sum sees the coarse ones only.
    """
    keys = list(keys)
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    before = lambda n, w: F.coalesce(F.sum(n).over(upto(w)), F.lit(0))
    two = isinstance(bucket, tuple)
    b = df.withColumn("_c", bucket[0] if two else bucket)
    level = ["_c"]
    if two:
        b, level = b.withColumn("_f", bucket[1]), ["_c", "_f"]
    counts = b.groupBy(*keys, *level).agg(F.count(F.lit(1)).alias("_n"))
    if two:
        inner = counts.withColumn("_in", before("_n", W.partitionBy(*keys, "_c").orderBy("_f")))
        outer = counts.groupBy(*keys, "_c").agg(F.sum("_n").alias("_m")).withColumn("_out", before("_m", W.partitionBy(*keys).orderBy("_c")))
        shift = inner.join(outer, [*keys, "_c"]).select(*keys, *level, (F.col("_in") + F.col("_out")).alias("_shift"))
    else:
        shift = counts.select(*keys, *level, before("_n", W.partitionBy(*keys).orderBy("_c")).alias("_shift"))
    ranked = b.withColumn("_r", F.row_number().over(W.partitionBy(*keys, *level).orderBy(*order)))
    return ranked.join(shift, [*keys, *level]).withColumn(name, F.col("_r") + F.col("_shift")).drop(*level, "_r", "_shift")


def key_buckets(key, fine=64, coarse=1 << 22):
    """(coarse, fine) buckets of a whole-number key."""
    return F.floor(F.col(key) / coarse), F.floor(F.col(key) / fine)


def first_k(df: DataFrame, keys, order, k, name="rank") -> DataFrame:
    """Top k per key; the rank limit is applied before the shuffle, so a hot key ships k rows per task."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def value_ranks(df: DataFrame, value, keys=(), width=1.0) -> DataFrame:
    """Distinct values per key with their count `n` and the rank of their last row `hi`.

    Equal values are counted first, so ranks run over distinct values only, bucket by bucket.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("_b", F.floor(F.col("v") / width))
    per = counts.groupBy(*keys, "_b").agg(F.sum("n").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(*keys)
    shift = per.select(
        *keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"), F.sum("_n").over(everything).alias("total")
    )
    inside = W.partitionBy(*keys, "_b").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.withColumn("_c", F.sum("n").over(inside)).join(shift, [*keys, "_b"]).select(
        *keys, "v", "n", (F.col("_c") + F.col("_shift")).alias("hi"), "total"
    )


def value_at(rank: Column) -> Column:
    """Aggregate over value_ranks: the value holding the 1-based rank."""
    return F.max(F.when((F.col("hi") >= rank) & (F.col("hi") - F.col("n") < rank), F.col("v")))
