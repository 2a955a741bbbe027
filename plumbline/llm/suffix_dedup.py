"""Exact substring dedup over bytes by sparse distributed prefix doubling.

Plain prefix doubling sorts a rank pair for every byte of the corpus in every round. Here positions drop out before they
are ever sorted: a repeated string of `window` bytes repeats with the FIRST bytes that its content alone chooses (those
with the smallest fingerprint), so only such anchors take part, and each round keeps those that are not unique yet.

  round 1  rank of the FIRST bytes at each anchor; anchors whose rank no other document has are unique and done
  round 2  rank pair (left, right) around the anchor, which spans every window over it; where all holders agree, or a
           document with a smaller id has the same pair, all of the anchor's windows are decided
  round 3  past the threshold: ranks of the single windows of the first holder of each pair that differs

Ranks are 64-bit fingerprints made by doubling (the rank of 2h bytes from those of its halves) instead of places in a
sort, so no rank needs the corpus; sorting them side by side finds the equal ones. Spark deals documents into chunks and
ranks into buckets; a chunk posts each rank once, with its smallest document, packed, and gets an answer of a bit or a
byte for each in the order it posted them. A passage that a third of all documents share is one rank per chunk.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.common import arrow_schema, batch_of, chunked
from plumbline.llm.rolling import NONE, anchors, runs, windows, windows_at

FIRST = 24
LOW = np.uint64((1 << 40) - 1)
#: Stands for a null id: behind all others.
LAST = np.iinfo(np.int64).max
#: Of an answer in round 2.
ALONE, FIRST_HOLDER, FIRST_OF_SEVERAL, LATER = 0, 1, 2, 3
POST = "bucket int,chunk int,names binary,pairs binary,docs binary,counts binary"
ANSWER = "chunk int,round int,bucket int,answers binary"


def five(names: np.ndarray) -> bytes:
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def from_five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


class Posted:
    """Entries of a chunk in the order it posts them: by bucket, then document, then rank, which content alone decides."""

    def __init__(self, names, pairs, docs, buckets):
        bucket = ((names if len(names) else pairs) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort([x for x in (pairs, names, docs, bucket) if len(x)] or [bucket])
        self.names, self.pairs, self.docs, self.bucket = (x[order] if len(x) else x for x in (names, pairs, docs, bucket))
        self.cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1)) if len(order) else np.zeros(1, int)

    def rows(self, chunk: int, schema: pa.Schema, with_docs=True) -> pa.Table:
        out = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            docs, counts = np.unique(self.docs[a:b], return_counts=True)
            out.append((int(self.bucket[a]), chunk, five(self.names[a:b]) if len(self.names) else b"", self.pairs[a:b].tobytes() if len(self.pairs) else b"",
                        docs.tobytes() if with_docs else np.packbits(self.docs[a:b] > 0).tobytes(), counts.astype(np.uint32).tobytes() if with_docs else b""))
        return batch_of(schema, out)

    def answers(self, replies: dict[int, bytes], bits: bool) -> np.ndarray:
        """One number an entry, in order, from the answers of its buckets."""
        out = np.zeros(len(self.bucket), np.uint8)
        for a, b in zip(self.cuts[:-1], self.cuts[1:]):
            data = np.frombuffer(replies[int(self.bucket[a])], np.uint8)
            out[a:b] = np.unpackbits(data, count=b - a) if bits else data
        return out


def smallest(docs: np.ndarray, *keys: np.ndarray):
    """Distinct keys (their columns) with the smallest document of each, and which of them each row has."""
    order = np.lexsort((docs, *keys[::-1]))
    fresh = np.zeros(len(docs), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[order][1:] != k[order][:-1]
    back = np.empty(len(docs), np.int64)
    back[order] = np.cumsum(fresh) - 1
    return [k[order][fresh] for k in keys], docs[order][fresh], back


class Chunk:
    """The documents of a chunk on their way through the rounds; each pass takes them as far as answers are there.

    Their bytes lie one behind the other, with zeros around each, and places are places there: windows are ranked over
    every byte in round 1 only, then at anchors and open windows alone.
    """

    def __init__(self, rows: pa.Table, replies: pa.Table | None, window: int, buckets: int):
        self.ids = rows["doc_id"].to_pylist()
        keys = [LAST if i is None else i for i in self.ids]
        texts = rows["text"].cast(pa.binary()).to_pylist()
        self.window, self.width, self.side = window, window - FIRST + 1, window - FIRST
        self.data = np.frombuffer(bytes(self.side).join([b"", *texts, b""]), np.uint8)
        self.size = np.array(list(map(len, texts)), np.int64)
        self.base = np.cumsum(self.size + self.side) - self.size
        self.replies = {1: {}, 2: {}, 3: {}}
        if replies is not None:
            for step, bucket, data in zip(replies["round"].to_pylist(), replies["bucket"].to_pylist(), replies["answers"].to_pylist()):
                self.replies[step][bucket] = data
        self.n = buckets
        # round 1
        ranks, places, counts = [NONE], [np.zeros(0, np.int64)], []
        for base, size in zip(self.base.tolist(), self.size.tolist()):
            rank, = windows(self.data[base : base + size], FIRST) if size >= window else (NONE,)
            at = np.flatnonzero(anchors(rank, self.width))
            ranks.append(rank[at])
            places.append(at + base)
            counts.append(len(at))
        self.ranks, self.places = np.concatenate(ranks), np.concatenate(places)
        self.owner = np.repeat(np.arange(len(keys)), counts)
        self.docs = np.array(keys, np.int64)[self.owner]
        self.names = self.ranks & LOW
        (distinct,), least, self.back = smallest(self.docs, self.names)
        several = np.zeros(len(distinct), np.int64)
        several[self.back[self.docs > least[self.back]]] = 1  # two documents of this chunk have it
        self.first = Posted(distinct, NONE, several, buckets)

    def second(self) -> Posted:
        """Of round 2: anchors whose rank another document has, with the rank pair around them."""
        again = self.first.answers(self.replies[1], bits=True).astype(bool)
        known = np.sort(self.first.names[again])
        found = np.minimum(np.searchsorted(known, self.names), max(len(known) - 1, 0))
        self.taken = np.flatnonzero(known[found] == self.names) if len(known) else np.zeros(0, np.int64)
        self.names, self.docs = self.names[self.taken], self.docs[self.taken]
        at, owner = self.places[self.taken], self.owner[self.taken]
        begin = at - self.base[owner]
        left, right = np.minimum(begin, self.side), np.minimum(self.size[owner] - FIRST - begin, self.side)
        around = windows_at(self.data, at - self.side, FIRST + 2 * self.side)
        self.pairs = around + (left * (self.side + 1) + right).astype(np.uint64)  # what is cut off counts
        (names, pairs), least, self.pair_of = smallest(self.docs, self.names, self.pairs)
        self.pair_first = self.docs == least[self.pair_of]
        posted = Posted(names, pairs, least, self.n)
        self.pair_order = (posted, names, pairs)
        return posted

    def smaller(self, some: np.ndarray, step: int) -> np.ndarray:
        """Place of the next anchor of smaller rank before (step -1) or behind (1) some anchors; any beyond `width` if none."""
        out = self.places[some] + step * self.width
        mine, other = np.arange(len(some)), some + step
        while len(mine):
            near = (other >= 0) & (other < len(self.places))
            near[near] = np.abs(self.places[other[near]] - self.places[some[mine[near]]]) < self.width
            mine, other = mine[near], other[near]
            less = self.ranks[other] < self.ranks[some[mine]]
            out[mine[less]] = self.places[other[less]]
            mine, other = mine[~less], other[~less] + step
        return out

    def starts(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last begin of the windows that chose these anchors: those over it that hold no smaller rank.

        The nearest smaller rank on either side is an anchor too, if a window over this one ends at it.
        """
        at, base, size = self.places[some], self.base[self.owner[some]], self.size[self.owner[some]]
        first = np.maximum(np.maximum(self.smaller(some, -1), at - self.width) + 1, base)
        last = np.minimum(np.minimum(self.smaller(some, 1) - self.width, at), base + size - self.window)
        return first, last

    def third(self) -> Posted:
        """Of round 3: the windows that are still open. What is decided goes to self.found, as first and last begins."""
        posted, names, pairs = self.pair_order
        answers = np.zeros(len(names), np.uint8)
        # posted order -> the order of distinct pairs
        place = np.lexsort((pairs, names))
        there = np.lexsort((posted.pairs, posted.names))
        answers[place] = posted.answers(self.replies[2], bits=False)[there]
        answer = answers[self.pair_of]
        decided = (answer == LATER) | ((answer > ALONE) & ~self.pair_first)
        pending = (answer == FIRST_OF_SEVERAL) & self.pair_first
        self.found = self.starts(self.taken[decided])
        first, last = self.starts(self.taken[pending])
        n = last - first + 1
        self.open = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        docs = np.repeat(self.docs[pending], n)
        (distinct,), least, self.window_of = smallest(docs, windows_at(self.data, self.open, self.window))
        self.later = docs > least[self.window_of]
        self.window_order = (Posted(NONE, distinct, least, self.n), distinct)
        return self.window_order[0]

    def removed(self) -> np.ndarray:
        """Mask of the bytes that go, over self.data."""
        posted, distinct = self.window_order
        answers = np.zeros(len(distinct), bool)
        if len(distinct):
            answers[np.searchsorted(distinct, posted.pairs)] = posted.answers(self.replies[3], bits=True).astype(bool)
        gone = self.open[answers[self.window_of] | self.later]
        edge = np.zeros(len(self.data) + 1, np.int32)
        for first, last in self.found, (gone, gone):
            np.add.at(edge, first, 1)
            np.add.at(edge, last + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def answered(posts: DataFrame, step: int) -> DataFrame:
    """The answers of all buckets to the posts of one round."""
    schema = arrow_schema(ANSWER)

    def run(rows: pa.Table) -> pa.Table:
        bucket, chunks = rows["bucket"][0].as_py(), rows["chunk"].to_pylist()
        names = [from_five(b) for b in rows["names"].to_pylist()]
        pairs = [np.frombuffer(b, np.uint64) for b in rows["pairs"].to_pylist()]
        size = [max(len(a), len(b)) for a, b in zip(names, pairs)]
        if step == 1:
            several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(rows["docs"].to_pylist(), size)])
            distinct, back, holders = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
            again = holders > 1
            again[back[several > 0]] = True
            out = again[back]
        else:
            docs = np.concatenate([np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.uint32)) for d, c in zip(rows["docs"].to_pylist(), rows["counts"].to_pylist())])
            pairs = np.concatenate(pairs)
            keys = (np.concatenate(names), pairs) if step == 2 else (pairs,)
            distinct, least, back = smallest(docs, *keys)
            out = docs > least[back]
            if step == 2:
                _, name_of, kinds = np.unique(distinct[0], return_inverse=True, return_counts=True)
                several = kinds[name_of][back] > 1
                out = np.where(out, LATER, np.where(several, FIRST_OF_SEVERAL, FIRST_HOLDER)).astype(np.uint8)
        ends = np.cumsum(size)
        return batch_of(schema, [(c, step, bucket, (out[e - n : e] if step == 2 else np.packbits(out[e - n : e])).tobytes()) for c, n, e in zip(chunks, size, ends)])

    return posts.groupBy("bucket").applyInArrow(run, ANSWER)


def without(data: np.ndarray, mask: np.ndarray) -> bytes:
    return data[~mask].tobytes()


def whole_characters(data: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mask without characters that it covers in part only, so that what stays is text."""
    lead = (data & 0xC0) != 0x80
    char = np.cumsum(lead) - 1
    kept = np.bincount(char, weights=~mask) > 0
    return ~kept[char]


def suffix_dedup(df: DataFrame, window=50, id_col="doc_id", text_col="text", with_text=False, carry=()) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (with_text: and `cleaned`; and `carry`, columns of df).

    Removed is each byte in a string of `window` bytes that also begins in a document with a smaller id; strings are
    those of the input. A null or empty text has no bytes. Rows with the same id are one document to each other: nothing
    of theirs is removed for the other. A null id is behind all ids. An empty table gives no rows; other columns are
    ignored. `cleaned` removes whole characters only: those with all their bytes in removed strings.
    """
    if window <= FIRST:
        raise ValueError(f"windows are of more than {FIRST} bytes")
    docs, chunks = chunked(df, id_col, text_col, carry)
    buckets = chunks // 4 + 1
    post = arrow_schema(POST)
    final = "doc_id long,n_bytes long,n_removed long,n_spans long,kept_sha256 string" + ",cleaned string" * with_text
    result = arrow_schema(final)
    number = lambda rows: rows["chunk"][0].as_py()

    def round_1(rows: pa.Table) -> pa.Table:
        return Chunk(rows, None, window, buckets).first.rows(number(rows), post, with_docs=False)

    def round_2(rows: pa.Table, replies: pa.Table) -> pa.Table:
        return Chunk(rows, replies, window, buckets).second().rows(number(rows), post) if len(rows) else batch_of(post, [])

    def round_3(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(rows):
            return batch_of(post, [])
        chunk = Chunk(rows, replies, window, buckets)
        chunk.second()
        return chunk.third().rows(number(rows), post)

    def removed(rows: pa.Table, replies: pa.Table) -> pa.Table:
        chunk = Chunk(rows, replies, window, buckets)
        chunk.second()
        chunk.third()
        gone = chunk.removed()
        out = []
        for doc_id, base, size in zip(chunk.ids, chunk.base.tolist(), chunk.size.tolist()):
            data, mask = chunk.data[base : base + size], gone[base : base + size]
            begins = runs(mask)[0] if mask.any() else ()
            cells = doc_id, size, int(np.count_nonzero(mask)), len(begins), hashlib.sha256(without(data, mask) if len(begins) else data).hexdigest()
            out.append((*cells, without(data, whole_characters(data, mask) if len(begins) else mask).decode("utf-8", "replace")) if with_text else cells)
        table = batch_of(result, out)
        for i in range(len(carry)):
            table = table.append_column(f"_{i}", rows[f"_{i}"])
        return table

    by_chunk = docs.groupBy("chunk")
    with_answers = lambda *given: by_chunk.cogroup(reduce_union(given).groupBy("chunk"))
    one = answered(by_chunk.applyInArrow(round_1, POST), 1)
    two = answered(with_answers(one).applyInArrow(round_2, POST), 2)
    three = answered(with_answers(one, two).applyInArrow(round_3, POST), 3)
    schema = T.StructType.fromDDL(final)
    for i, c in enumerate(carry):
        schema.add(f"_{i}", df.schema[c].dataType)
    out = with_answers(one, two, three).applyInArrow(removed, schema)
    return out.select(*result.names, *[F.col(f"_{i}").alias(c) for i, c in enumerate(carry)])


def reduce_union(frames) -> DataFrame:
    out, *rest = frames
    for df in rest:
        out = out.unionByName(df)
    return out
