"""Benchmark decontamination by q-gram lemma filtering.

A passage within e edits of an item of m bytes shares at least m + 1 - q (e + 1) of its q-grams, on diagonals that lie
within e of each other. Documents are scanned for q-grams of the benchmark; hits are counted in diagonal bands of e + 1,
two neighbours together, so that any such passage falls into one; regions that meet the bound are verified by banded
alignment of the whole item. q is 8, but smaller for short items whose bound would be 0: the largest that gives 1, which
is m // (e + 1); each q has an index of its own. Texts are compared in lower case with runs of white space as one blank.

Items of fewer than 8 bytes are looked for as whole words, without edits.

The benchmark is sent to the executors in blocks of at most BLOCK_BYTES; each block is one scan of the documents.
"""

import math
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import arrow_schema, durable, text_of

Q = 8
BLOCK_BYTES = 8 << 20
#: Bytes hashed at a time; bits of the table that tells most q-grams of a document from those of the benchmark.
BUFFER, BITS = 1 << 20, 22
MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "replace")


def q_grams(data: np.ndarray, q=Q) -> np.ndarray:
    """Every q bytes of `data` as one number."""
    if q < Q:
        out = np.zeros(max(0, len(data) - q + 1), np.uint64)
        for k in range(q):
            out = (out << np.uint64(8)) | data[k : k + len(out)]
        return out
    out, step = data.astype(np.uint64), 1
    while step < Q:
        out = (out[:-step] << np.uint64(8 * step)) | out[step:]
        step *= 2
    return out


def slot(grams: np.ndarray) -> np.ndarray:
    return (grams * MIX) >> np.uint64(64 - BITS)


class Index:
    """Q-grams of a block of items, with where they stand."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float, q=Q):
        self.q = q
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.floor(self.sizes * rate).astype(np.int64)
        self.least = np.maximum(1, self.sizes + 1 - q * (self.edits + 1))
        grams = [q_grams(np.frombuffer(t, np.uint8), q) for t in self.texts]
        flat = np.concatenate(grams)
        order = np.argsort(flat, kind="stable")
        self.item = np.repeat(np.arange(len(items)), [len(g) for g in grams])[order]
        self.at = np.concatenate([np.arange(len(g)) for g in grams])[order]
        self.grams, self.first, self.n = np.unique(flat[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << BITS, bool)
        self.seen[slot(self.grams)] = True

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `data` with a q-gram of the block, and which one it is."""
        places, which = [], []
        for begin in range(0, max(0, len(data) - self.q + 1), BUFFER):
            grams = q_grams(data[begin : begin + BUFFER + self.q - 1], self.q)
            near = np.flatnonzero(self.seen[slot(grams)])
            found = np.minimum(np.searchsorted(self.grams, grams[near]), len(self.grams) - 1)
            same = self.grams[found] == grams[near]
            places.append(near[same] + begin)
            which.append(found[same])
        return (np.concatenate(places), np.concatenate(which)) if places else (np.zeros(0, int), np.zeros(0, int))


def indexes(items: list[tuple[int, bytes]], rate: float) -> list[Index]:
    """An index for each q that items need: a passage within their edits shares at least one of their q-grams."""
    by_q = {}
    for i, text in items:
        by_q.setdefault(max(1, min(Q, len(text) // (math.floor(len(text) * rate) + 1))), []).append((i, text))
    return [Index(some, rate, q) for q, some in by_q.items()]


def align(item: bytes, text: bytes, band: int, most: int):
    """(distance, start, end) of the passage of `text` nearest to `item` that starts in its first `band` bytes, if within `most` edits."""
    at = text.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    a = np.frombuffer(item, np.uint8).astype(np.int16)
    b = np.full(len(a) + band + 1, -1, np.int16)
    n = min(len(b), len(text))
    b[:n] = np.frombuffer(text[:n], np.uint8)
    lane = np.arange(band)
    cost, start = np.zeros(band, np.int64), lane.copy()
    for i in range(len(a)):
        swap = cost + (b[i : i + band] != a[i])
        drop = np.append(cost[1:] + 1, most + 1)
        best = np.minimum(swap, drop)
        begun = np.where(swap <= drop, start, np.append(start[1:], 0))
        level = np.minimum.accumulate(best - lane)
        origin = np.maximum.accumulate(np.where(best - lane == level, lane, 0))
        cost, start = level + lane, begun[origin]
        if cost.min() > most:
            return None
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), min(len(a) + end, len(text))


def scan(docs: list[bytes], index: Index):
    """(document's place, item id, distance, start, end) of the nearest passage of each item in each document."""
    sizes = np.array([len(d) + 1 for d in docs], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    places, which = index.hits(np.frombuffer(b"\0".join(docs), np.uint8))
    if not len(places):
        return
    # a hit for every place of the q-gram in an item
    n = index.n[which]
    posting = np.repeat(index.first[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item, at = index.item[posting], index.at[posting]
    where = np.repeat(places, n)
    doc = np.searchsorted(begins, where, "right") - 1
    longest = int(index.sizes.max())
    wide = index.edits[item] + 1
    bands = (begins[-1] + longest) + 2
    key = (doc * len(index.ids) + item) * bands + (where - begins[doc] - at + longest) // wide
    keys, count = np.unique(key, return_counts=True)
    pair = count.copy()
    pair[:-1] += np.where(keys[1:] == keys[:-1] + 1, count[1:], 0)
    owner, band = keys // bands, keys % bands
    # a band without hits of its own below a full one needs no look: the one above it is judged by itself
    found = {}
    for k in np.flatnonzero(pair >= index.least[owner % len(index.ids)]):
        d, i = divmod(int(owner[k]), len(index.ids))
        e = int(index.edits[i])
        low = int(band[k]) * (e + 1) - longest
        begin = max(0, low - e)
        room = low + 2 * (e + 1) + e - begin
        if room <= 0:
            continue
        met = align(index.texts[i], docs[d][begin : low + 2 * (e + 1) + e + int(index.sizes[i]) + e], room, e)
        if met and (d, i) not in found or met and met[0] < found[d, i][0]:
            found[d, i] = (met[0], met[1] + begin, met[2] + begin)
    for (d, i), (distance, start, end) in found.items():
        yield d, index.ids[i], distance, start, end


def whole_words(docs: list[bytes], short: dict[bytes, list[int]]):
    """(document's place, item id, 0, start, end) of the first place where a short item stands as whole words of a document."""
    lengths = sorted({text.count(b" ") + 1 for text in short})
    for d, body in enumerate(docs):
        spans = [m.span() for m in re.finditer(rb"[^ ]+", body)]
        found = {}
        for n in lengths:
            for first, last in zip(spans, spans[n - 1 :]):
                if last[1] - first[0] < Q:
                    text = body[first[0] : last[1]]
                    if text in short:
                        found.setdefault(text, (first[0], last[1]))
        for text, (start, end) in found.items():
            for i in short[text]:
                yield d, i, 0, start, end


def contaminated(df: DataFrame, benchmark: DataFrame, rate=0.1, id_col="doc_id", text_col="text", key_col=None) -> DataFrame:
    """One row for each document and benchmark item it holds within rate * (bytes of the item) edits.

    doc_id, item_id, distance (edits), start and end (bytes of the normalised text) of the nearest passage. Clean
    documents have no row. Items of fewer than 8 bytes are held by documents that have them as whole words, unchanged but
    for case and white space; empty or null ones by none; null or empty texts hold nothing. Repeated rows are each reported; null ids stay null; other columns are ignored but for
    `key_col`, if given: it is handed through as `row_key`.
    """
    spark = df.sparkSession
    ddl = "doc_id long,item_id long,distance int,start long,end long" + ",row_key long" * bool(key_col)
    schema = arrow_schema(ddl)
    items = durable(benchmark.filter(F.octet_length("text") > 0).select("item_id", "text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    texts = text_of(df, id_col, text_col, key_col)

    def one(block):
        rows = [(r.item_id, normal(r.text)) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toLocalIterator()]
        rows = [(i, t) for i, t in rows if t]
        if not rows:
            return spark.createDataFrame([], ddl)
        sent = spark.sparkContext.broadcast(rows)  # about BLOCK_BYTES

        def run(batches):
            made = indexes([(i, t) for i, t in sent.value if len(t) >= Q], rate)
            short = {}
            for i, t in sent.value:
                if len(t) < Q:
                    short.setdefault(t, []).append(i)
            for batch in batches:
                out, held, size = [], [], 0

                def flush():
                    bodies = [t for _, t, *_ in held]
                    for d, i, distance, start, end in chain(*(scan(bodies, index) for index in made), whole_words(bodies, short) if short else ()):
                        out.append((held[d][0], i, distance, start, end, *held[d][2:]))

                for doc_id, text, *key in zip(*(c.to_pylist() for c in batch.columns)):
                    held.append((doc_id, normal(text), *key))
                    size += len(held[-1][1])
                    if size >= BUFFER:
                        flush()
                        held, size = [], 0
                if held:
                    flush()
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * len(schema), schema.types)], schema=schema)

        return texts.mapInArrow(run, ddl)

    out = one(0)
    for block in range(1, blocks):
        out = out.unionByName(one(block))
    return out
