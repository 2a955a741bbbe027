"""Sharding by histogram sort, in DataFrame operations only.

Documents are put in the order of a 128-bit key: the hash of the text (equal texts lie together), then the hash of the
document's id, which divides a group of equal texts however large it is. Shard boundaries are found by histograms: exact
bytes are summed below candidate boundaries, 4096 of them across the range, and each interval that a boundary falls into
is probed again, 4096 times finer, until every boundary is within `tolerance` of its aim or an interval holds rows of
one key only. The driver sees at most shards x 4096 sums. Then rows go to their shards in one exchange.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.llm.common import durable

#: Bits that one histogram splits an interval by; bits of each half of the key.
STEP, HALF = 12, 60
ROW_BYTES = 16


def digits(level: int):
    """The key's digits number 0 to level - 1, as columns d0, d1, ... over the two halves."""
    per = HALF // STEP
    return [F.expr(f"shiftrightunsigned({'kt' if i < per else 'ki'}, {64 - STEP * (i % per + 1)}) & {(1 << STEP) - 1}").cast("int").alias(f"d{i}") for i in range(level)]


def keyed(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("kt"), F.xxhash64(F.col(id_col), F.length(text)).alias("ki"),
    )


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, ...]]:
    """shards - 1 boundaries, each a prefix of digits: a row is behind it if its digits are at or above that prefix.

    Every round is one histogram over all rows for all boundaries still open.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return []
    slack = tolerance * total / shards
    aims = {s: total * s / shards for s in range(1, shards)}
    found = {}
    below = {(): 0}  # interval -> bytes below it, for the intervals with an open boundary
    where = dict.fromkeys(aims, ())
    for level in range(1, 2 * HALF // STEP + 1):
        cols = digits(level)
        names = [f"d{i}" for i in range(level)]
        probed = rows.select("size", *cols)
        if level > 1:  # at most shards - 1 intervals
            marks = spark.createDataFrame(sorted({*where.values()}), ", ".join(f"{n} int" for n in names[:-1]))
            probed = probed.join(F.broadcast(marks), names[:-1], "left_semi")
        sums = sorted((tuple(r[n] for n in names), r["b"]) for r in probed.groupBy(*names).agg(F.sum("size").alias("b")).collect())
        inside = {}
        for path, b in sums:
            inside.setdefault(path[:-1], []).append((path, b))
        opened = {}
        for s, interval in where.items():
            at = below[interval]
            for path, b in inside[interval]:
                if at + b > aims[s]:
                    break
                at += b
            # the boundary lies in [at, at + b): take an end if it is near enough or nothing divides the interval further
            near = (path, at) if aims[s] - at <= at + b - aims[s] else (path[:-1] + (path[-1] + 1,), at + b)
            if abs(near[1] - aims[s]) <= slack or level == 2 * HALF // STEP:
                found[s] = near[0]
            else:
                opened[s], below[path] = path, at
        where = opened
        if not where:
            break
    return [found[s] for s in sorted(found)]


def behind(prefix: tuple[int, ...]):
    """Condition: the row's digits are at or above the prefix."""
    at = digits(len(prefix))
    out = at[-1] >= prefix[-1]
    for col, d in zip(at[-2::-1], prefix[-2::-1]):
        out = (col > d) | ((col == d) & out)
    return out


def shard(df: DataFrame, shards: int, tolerance=0.001, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null: it holds for another law).

    Sizes of shards are nearly equal: each boundary is within `tolerance` of a shard's size from its aim, or as near as
    single rows allow. Null texts count as empty; repeated rows and null ids each get a slot; rows alike in all columns
    get theirs in any order. An empty table gives no rows, fewer rows than shards leave shards empty. Other columns are
    ignored.
    """
    rows = durable(keyed(df, id_col, text_col))
    at = F.lit(0)
    for prefix in splitters(rows, shards, tolerance):
        at = at + behind(prefix).cast("int")
    # cells keep any window's partition small: by the order of texts, then by that of ids
    cells = rows.select("*", at.cast("int").alias("shard"), F.expr("shiftrightunsigned(kt, 52)").alias("c1"), F.expr("shiftrightunsigned(ki, 58)").alias("c2"))
    cell = ["shard", "c1", "c2"]
    counts = cells.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    first = counts.select(*cell, F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("c1", "c2").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    inside = F.row_number().over(W.partitionBy(*cell).orderBy("kt", "ki", "doc_id", "size", "text_crc32"))
    placed = cells.withColumn("inside", inside).join(first, cell)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("inside") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
