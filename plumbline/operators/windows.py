"""Positions, chunks and batches; set operations on rows and arrays."""

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators import scale


def totals(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def with_total(positioned: DataFrame, keys) -> DataFrame:
    keys = list(keys)
    if keys:
        return positioned.join(totals(positioned, keys), keys)
    n = positioned.agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(1))
    return positioned.withColumn("_k", F.lit(1)).join(n, "_k").drop("_k")


def chunk_of(pos, n, k) -> Column:
    """Chunk of a position when n rows are cut into k contiguous, nearly equal parts."""
    size, more = F.floor(n / k), n % k
    big = more * (size + 1)
    chunk = F.when(pos <= big, F.ceil(pos / (size + 1))).otherwise(more + F.ceil((pos - big) / F.greatest(size, F.lit(1))))
    return chunk.cast("long")


def split_evenly(df: DataFrame, order, bucket, k, keys=(), name="chunk") -> DataFrame:
    """k contiguous chunks of nearly equal size; the first ones take the remainder."""
    p = with_total(scale.positions(df, order, bucket, keys, "_p"), keys)
    return p.withColumn(name, chunk_of(F.col("_p"), F.col("_n"), k)).drop("_p", "_n")


def half_split(df: DataFrame, order, bucket, keys=(), name="half") -> DataFrame:
    """First half is the first n div 2 rows."""
    p = with_total(scale.positions(df, order, bucket, keys, "_p"), keys)
    return p.withColumn(name, F.when(F.col("_p") <= F.floor(F.col("_n") / 2), 1).otherwise(2)).drop("_p", "_n")


def batches(df: DataFrame, order, bucket, size, keys=(), name="batch") -> DataFrame:
    p = scale.positions(df, order, bucket, keys, "_p")
    return p.withColumn(name, F.floor((F.col("_p") - 1) / size).cast("long")).drop("_p")


def extremes(df: DataFrame, key, order, cols, last=False) -> DataFrame:
    """First or last row per key, as a map-side aggregate."""
    pick = F.max_by if last else F.min_by
    return df.groupBy(key).agg(pick(F.struct(*cols), F.struct(*order)).alias("r")).select(key, "r.*")


def ranked_methods(df: DataFrame, score, name) -> Column:
    """Position by falling score, then name."""
    return F.struct((-F.col(score)).alias("s"), F.col(name).alias("m"))


def intersect_scope(df: DataFrame, key, source, member) -> DataFrame:
    """Members that every source of a key has."""
    n = df.groupBy(key).agg(F.count_distinct(source).alias("_all"))
    m = df.groupBy(key, member).agg(F.count_distinct(source).alias("_have"))
    return m.join(n, key).filter("_have = _all").select(key, member)


def except_both_ways(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def is_subset(a, b) -> Column:
    return F.size(F.array_except(a, b)) == 0
