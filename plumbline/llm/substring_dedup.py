"""Substring dedup with repeated-phrase automata, over words.

1. Phrases: each window of `window` words holds one phrase of PHRASE words that its content alone chooses (the one with
   the smallest fingerprint), so a recurring window recurs with its phrase. Chunks of documents send the fingerprints of
   their chosen phrases to buckets, which answer which of them recur anywhere.
2. Automata: each chunk compiles the confirmed phrases it holds into an Aho-Corasick automaton over word numbers - these
   are the shards - and streams its documents through it; every place of every recurring phrase comes out. Only windows
   around those places can recur: their fingerprints go to buckets, which answer which do.
3. Words in a recurring window are removed.

Fingerprints are collected by chunk and bucket and packed, so a passage that a third of the documents share is one
number per chunk, not a row per place.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import arrow_schema, batch_of, chunked
from plumbline.llm.rolling import WordPrints, anchors, covered, windows

SENT = "bucket int,chunk int,names binary,twice binary"
REPLY = "chunk int,names binary"


#: Of this worker process.
_prints = WordPrints()


class Words:
    """The documents of a chunk as words (UTF-8) and their fingerprints."""

    def __init__(self, texts: list[str]):
        self.words = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # bytes are split at ASCII white space
        self.prints = [_prints.of(ws) for ws in self.words]

    def windows(self, doc: int, *lengths: int):
        return windows(self.prints[doc], *lengths)

    def numbers(self) -> list[list[int]]:
        """The words numbered within the chunk."""
        _, flat = np.unique(np.concatenate(self.prints), return_inverse=True)
        return [x.tolist() for x in np.split(flat, np.cumsum([len(p) for p in self.prints])[:-1])]


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the values are in `known`, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def post(chunk: int, names: np.ndarray, buckets: int, schema: pa.Schema) -> pa.Table:
    """A chunk's fingerprints, once each, by bucket; `twice` marks those that it holds more than once."""
    names, times = np.unique(names, return_counts=True)
    bucket = (names % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    names, twice, bucket = names[order], times[order] > 1, bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    return batch_of(schema, [(int(bucket[a]), chunk, names[a:b].tobytes(), np.packbits(twice[a:b]).tobytes()) for a, b in zip(cuts[:-1], cuts[1:])])


def recurring(sent: DataFrame) -> DataFrame:
    """To each chunk its fingerprints that it or another chunk holds again."""
    schema = arrow_schema(REPLY)

    def run(rows: pa.Table) -> pa.Table:
        chunks, blobs = rows["chunk"].to_pylist(), rows["names"].to_pylist()
        names = [np.frombuffer(b, np.uint64) for b in blobs]
        twice = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(n)).astype(bool) for b, n in zip(rows["twice"].to_pylist(), names)]
        distinct, back, holders = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
        again = holders > 1
        again[back[np.concatenate(twice)]] = True
        out, at = [], 0
        for chunk, n in zip(chunks, names):
            kept = n[again[back[at : at + len(n)]]]
            at += len(n)
            if len(kept):
                out.append((chunk, kept.tobytes()))
        return batch_of(schema, out)

    return sent.groupBy("bucket").applyInArrow(run, REPLY)


def locate(words: Words, phrases: np.ndarray, phrase: int, window: int):
    """The places of recurring phrases, by document: an automaton of the phrases, all documents streamed through it."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    numbered, added = words.numbers(), set()
    for doc, numbers in enumerate(numbered):
        prints, = words.windows(doc, phrase)
        chosen = np.flatnonzero(anchors(prints, window - phrase + 1))
        chosen = chosen[among(prints[chosen], phrases)]
        for at, name in zip(chosen.tolist(), prints[chosen].tolist()):
            if name not in added:
                added.add(name)
                automaton.add_word(tuple(numbers[at : at + phrase]))
    if not added:
        return
    automaton.make_automaton()
    for doc, numbers in enumerate(numbered):
        if len(numbers) >= window:
            ends = np.array([end for end, _ in automaton.iter(tuple(numbers))], np.int64)
            if len(ends):
                yield doc, ends - phrase + 1


def substring_dedup(df: DataFrame, window=35, id_col="doc_id", text_col="text", with_text=False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space; with_text: and `cleaned`).

    Removed is each word in a window of `window` words that also begins anywhere else, the same document included; the
    windows are those of the input. A null or empty text has no words. A repeated row is another document: its windows
    recur. Null ids come out as they went in; an empty table gives no rows; other columns are ignored.
    """
    phrase = max(1, window * 3 // 7)
    docs, n = chunked(df, id_col, text_col)
    sent, final = arrow_schema(SENT), "doc_id long,n_words long,n_removed long,kept_sha256 string" + ",cleaned string" * with_text
    result = arrow_schema(final)

    def phrases_of(rows: pa.Table) -> pa.Table:
        words = Words(rows["text"].to_pylist())
        names = [p[anchors(p, window - phrase + 1)] for p in (words.windows(d, phrase)[0] for d in range(len(words.words)))]
        return post(rows["chunk"][0].as_py(), np.concatenate(names), n, sent)

    def windows_of(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(rows) or not len(replies):
            return batch_of(sent, [])
        words = Words(rows["text"].to_pylist())
        names = []
        phrases = np.sort(np.frombuffer(b"".join(replies["names"].to_pylist()), np.uint64))
        for doc, places in locate(words, phrases, phrase, window):
            prints, = words.windows(doc, window)
            near = covered(np.maximum(places - (window - phrase), 0), window - phrase + 1, len(prints) + window)[: len(prints)]
            names.append(prints[near])
        return post(rows["chunk"][0].as_py(), np.concatenate(names), n, sent) if names else batch_of(sent, [])

    def removed(rows: pa.Table, replies: pa.Table) -> pa.Table:
        words = Words(rows["text"].to_pylist())
        again = np.sort(np.frombuffer(b"".join(replies["names"].to_pylist()), np.uint64))
        out = []
        for doc, (doc_id, ws) in enumerate(zip(rows["doc_id"].to_pylist(), words.words)):
            gone = 0
            if len(again) and len(ws) >= window:
                prints, = words.windows(doc, window)
                starts = np.flatnonzero(among(prints, again))
                if len(starts):
                    mask = covered(starts, window, len(ws))
                    gone = int(mask.sum())
                    ws = [w for w, m in zip(ws, mask.tolist()) if not m]
            text = b" ".join(ws)
            out.append((doc_id, len(ws) + gone, gone, hashlib.sha256(text).hexdigest(), *([text.decode("utf-8", "replace")] if with_text else [])))
        return batch_of(result, out)

    by_chunk = docs.groupBy("chunk")
    confirmed = recurring(by_chunk.applyInArrow(phrases_of, SENT))
    again = recurring(by_chunk.cogroup(confirmed.groupBy("chunk")).applyInArrow(windows_of, SENT))
    return by_chunk.cogroup(again.groupBy("chunk")).applyInArrow(removed, final)
