"""Importance resampling towards a target: hashed n-gram weights over a head-tail vocabulary, Gumbel top-k draw.

Features are words and pairs of words, hashed by CRC-32. The corpus' most frequent words and pairs are found first (by
counts over all texts) and broadcast: a head word carries its CRC state, a head pair its bucket. Anything else, the
tail, takes its CRC directly, a pair by going on from its first word's state. Both give the same buckets, so the head
decides about speed only; bucket totals are exact. A document's weight is the mean gain of its features' buckets.
"""

import math
import uuid
import zlib
from collections import Counter, defaultdict
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.llm.common import arrow_schema, batch_of, durable, text_of

#: A-Z in lower case; all ASCII but digits and letters ends a word.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Head words and pairs, the longest head word in bytes, candidates that a task keeps while it counts, and the share
#: (1 in so many) of all counts that a candidate has.
WORDS, PAIRS, LONGEST, KEPT, SHARE = 1 << 15, 1 << 16, 32, 1 << 18, 1 << 18
#: Bytes of text whose features are looked up together, and pieces that longer texts are cut into.
GROUP = 1 << 20


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(LOWER).split()


def pieces(text: str):
    """(words, led) of a text in pieces of about GROUP bytes; `led`: the first word is the last one of the piece before."""
    data = text.encode("utf-8", "replace").translate(LOWER)
    at, last = 0, []
    while at < len(data):
        end = data.find(b" ", at + GROUP)
        words = data[at : end if end >= 0 else len(data)].split()
        if words:
            yield last + words, bool(last)
            last = words[-1:]
        at = end if end >= 0 else len(data)


def groups(texts):
    """Lists of (row, words, led): rows in order, about GROUP bytes in a list."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for words, led in pieces(text):
            held.append((row, words, led))
            size += sum(map(len, words))
            if size >= GROUP:
                yield held
                held, size = [], 0
    if held:
        yield held


# ---- the head


def repeated(held):
    """(words, pairs) that occur twice or more in a group of pieces, with their counts."""
    numbers = defaultdict(count().__next__)
    words = [w for _, ws, _ in held for w in ws]
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    names, ends = list(numbers), np.cumsum([len(ws) for _, ws, _ in held])
    own = np.ones(len(words), bool)
    own[np.concatenate([[0], ends[:-1]])[[led for _, _, led in held]]] = False
    inner = np.ones(len(words), bool)
    inner[ends - 1] = False
    often = np.bincount(ids[own], minlength=len(names))
    pairs, times = np.unique(ids[:-1][inner[:-1]] * len(names) + ids[1:][inner[:-1]], return_counts=True)
    pairs, times = pairs[times > 1], times[times > 1]
    firsts, seconds = np.divmod(pairs, max(len(names), 1))
    ones = {names[i]: n for i, n in zip(np.flatnonzero(often > 1).tolist(), often[often > 1].tolist())}
    return ones, {names[i] + b" " + names[j]: n for i, j, n in zip(firsts.tolist(), seconds.tolist(), times.tolist())}


def head(texts: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """The most frequent words, and the most frequent pairs of them (joined by a space): WORDS and PAIRS of them at most.

    A task counts what recurs within its groups of texts and forgets the rarer half of more than 2 KEPT. Candidates hold
    at least 1 in SHARE of all that was counted, so there are at most SHARE of them at the driver.
    """
    schema = arrow_schema("size int,feature binary,n long")

    def run(batches):
        seen = Counter(), Counter()
        for batch in batches:
            for held in groups(batch.column(1).to_pylist()):
                for kept, found in zip(seen, repeated(held)):
                    kept.update(found)
                    if len(kept) > 2 * KEPT:
                        some = kept.most_common(KEPT)
                        kept.clear()
                        kept.update(dict(some))
        rows = []
        for size, kept in enumerate(seen, 1):
            least = kept.total() // SHARE
            rows += [(size, f, n) for f, n in kept.items() if n >= least and max(map(len, f.split(b" "))) <= LONGEST]
        yield from batch_of(schema, rows).to_batches()

    counted = durable(texts.mapInArrow(run, "size int,feature binary,n long").groupBy("size", "feature").agg(F.sum("n").alias("n")))
    total = {r[0]: r[1] for r in counted.groupBy("size").agg(F.sum("n")).collect()}

    def top(size, most):
        found = counted.filter((F.col("size") == size) & (F.col("n") * SHARE >= total.get(size, 0))).select("n", "feature").collect()
        return [bytes(f) for _, f in sorted(found, key=lambda r: (-r[0], bytes(r[1])))[:most]]

    return top(1, WORDS), top(2, PAIRS)


class Vocabulary:
    """Head words with their CRC states and head pairs with their buckets, for look-ups by the group."""

    def __init__(self, words: list[bytes], pairs: list[bytes], buckets: int):
        self.buckets, self.ids = buckets, {w: i for i, w in enumerate(words)}
        self.states = np.array([zlib.crc32(w) for w in words] or [0], np.uint32)
        n = len(words) or 1
        found = [(self.ids[a] * n + self.ids[b], zlib.crc32(p) % buckets) for p in pairs for a, b in [p.split(b" ")] if a in self.ids and b in self.ids]
        found.sort()
        self.keys = np.array([k for k, _ in found] or [-1], np.int64)
        self.pair_buckets = np.array([b for _, b in found] or [0], np.int64)
        self.n = n

    def of(self, held) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buckets of words, buckets of the pairs they begin, ends of pieces); -1 where a piece has no such feature."""
        words = [w for _, ws, _ in held for w in ws]
        ends = np.cumsum([len(ws) for _, ws, _ in held])
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        states = self.states[ids]
        tail = np.flatnonzero(ids < 0)
        states[tail] = [zlib.crc32(words[i]) for i in tail.tolist()]
        one = (states % np.uint32(self.buckets)).astype(np.int64)
        lasts, starts = ends - 1, np.concatenate([[0], ends[:-1]])
        one[starts[[led for _, _, led in held]]] = -1
        two = np.full(len(words), -1, np.int64)
        both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        keys = ids[both] * self.n + ids[both + 1]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        two[both[hit]] = self.pair_buckets[at[hit]]
        inner = np.ones(len(words), bool)
        inner[lasts] = False
        rest = np.flatnonzero(inner & (two < 0))
        crcs = np.fromiter((zlib.crc32(b" " + words[i + 1], s) for i, s in zip(rest.tolist(), states[rest].tolist())), np.int64, len(rest))
        two[rest] = crcs % self.buckets
        two[lasts] = -1
        return one, two, ends


#: The vocabulary of this worker process, by the name it was broadcast under.
_vocabulary: dict = {}


def vocabulary(broadcast, buckets: int) -> Vocabulary:
    name, words, pairs = broadcast.value
    if name not in _vocabulary:
        _vocabulary.clear()
        _vocabulary[name] = Vocabulary(words, pairs, buckets)
    return _vocabulary[name]


# ---- totals, gains and weights


def bucket_totals(texts: DataFrame, frequent, buckets: int) -> np.ndarray:
    """Features per bucket over all texts: each task sends its own totals, `buckets` numbers reach the driver."""
    schema = arrow_schema("bucket int,n long")

    def run(batches):
        total, known = np.zeros(buckets, np.int64), vocabulary(frequent, buckets)
        for batch in batches:
            for held in groups(batch.column(1).to_pylist()):
                one, two, _ = known.of(held)
                total += np.bincount(one[one >= 0], minlength=buckets) + np.bincount(two[two >= 0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met, pa.int32()), pa.array(total[met])], schema=schema)

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(run, "bucket int,n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln of how much likelier the target makes it), add-one smoothed."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weights(texts: DataFrame, frequent, gain, buckets: int) -> DataFrame:
    """(doc_id, n_features, weight) per row: the floored mean gain of its features, 0 without any."""
    ddl = "doc_id long,n_features long,weight long"
    schema = arrow_schema(ddl)

    def run(batches):
        known, per_bucket = vocabulary(frequent, buckets), np.append(gain.value, 0)  # -1 finds the 0
        for batch in batches:
            n, total = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for held in groups(batch.column(1).to_pylist()):
                one, two, ends = known.of(held)
                rows, starts = np.array([row for row, _, _ in held]), np.concatenate([[0], ends[:-1]])
                for sums, cells in ((total, per_bucket[one] + per_bucket[two]), (n, (one >= 0).astype(np.int64) + (two >= 0))):
                    upto = np.concatenate([[0], np.cumsum(cells)])
                    np.add.at(sums, rows, upto[ends] - upto[starts])
            mean = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(n), pa.array(mean)], schema=schema)

    return texts.select("doc_id", "text").mapInArrow(run, ddl)


def noise(seed: int) -> F.Column:
    """Standard Gumbel noise in thousandths from the hash of seed and doc_id, floored (a null id: as an empty string)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranges(kinds: DataFrame, times: str, best, order) -> DataFrame:
    """The kinds of rows with `_last`, the place of their last copy by `best` (of "score") and `order` (of "doc_id" first).

    Places are summed inside blocks of 4,096 ids of one score, then over the blocks of a score, then over the scores.
    """
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    before = lambda n, w: F.coalesce(F.sum(n).over(upto(w)), F.lit(0))
    block = F.struct(F.col("doc_id").isNull().alias("void"), F.floor(F.col("doc_id") / 4096).alias("at"))
    rows = kinds.withColumn("_block", block)
    blocks = rows.groupBy("score", "_block").agg(F.sum(times).alias("_n")).withColumn("_in", before("_n", W.partitionBy("score").orderBy("_block")))
    scores = kinds.groupBy("score").agg(F.sum(times).alias("_m")).withColumn("_out", before("_m", W.orderBy(best)))
    shift = blocks.join(scores, "score").select("score", "_block", (F.col("_in") + F.col("_out")).alias("_shift"))
    inside = F.sum(times).over(W.partitionBy("score", "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("_last", inside).join(shift, ["score", "_block"]).withColumn("_last", F.col("_last") + F.col("_shift")).drop("_block", "_shift")


def importance_resample(
    df: DataFrame, target: DataFrame, share=25, least_words=20, seed=7, buckets=10_000, id_col="doc_id", text_col="text", target_text="text"
) -> DataFrame:
    """Per row: doc_id, n_features, weight, score, rank (1 for the best of the drawn; null if not drawn).

    Of the rows with at least `least_words` words `share` in a hundred are drawn, by score; ties go to the smaller doc_id
    (null last), then fewer features. Null and empty texts have no features and weight 0, on
    both sides; empty tables draw nothing. Every row is weighted and ranked on its own, repeated ones too; other columns
    are ignored. Rows that come out equal are counted before they are ranked, so that a flood of copies is one row there.
    """
    spark = df.sparkSession
    texts, aim = text_of(df, id_col, text_col).select("doc_id", "text"), text_of(target.withColumn("_no", F.lit(0)), "_no", target_text)
    frequent = spark.sparkContext.broadcast((uuid.uuid4().hex, *head(texts)))  # WORDS words and PAIRS pairs at most
    gain = spark.sparkContext.broadcast(gains(bucket_totals(texts, frequent, buckets), bucket_totals(aim, frequent, buckets)))
    told = weights(texts, frequent, gain, buckets).withColumn("score", F.col("weight") + noise(seed))
    long_enough = F.col("n_features") >= 2 * least_words - 1
    kinds = durable(told.groupBy("doc_id", "n_features", "weight", "score").agg(F.count(F.lit(1)).alias("_times")))
    rows = kinds.agg(F.sum(F.when(long_enough, F.col("_times")))).first()[0] or 0
    drawn = rows * share // 100
    ranked = ranges(kinds.filter(long_enough), "_times", F.desc("score"), [F.asc_nulls_last("doc_id"), F.asc("n_features")])
    place = F.explode(F.sequence(F.col("_last") - F.col("_times") + 1, F.col("_last")))
    ranked = ranked.select("doc_id", "n_features", "weight", "score", place.alias("rank")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = kinds.filter(~long_enough).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return ranked.unionByName(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
