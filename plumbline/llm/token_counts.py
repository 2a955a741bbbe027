"""Token counts by a two-tier lookup: a broadcast table of frequent pre-tokens, then a cache in each worker.

The merges of the tokenizer never cross from a letter into a following space (no piece of its vocabulary has a space
inside), so a text's tokens are those of its pre-tokens: a run of spaces with the word behind it. Counting is a sum of
looked-up lengths, text by text, where the texts lie: no pre-token is shuffled. The table of frequent pre-tokens comes
from a bounded summary of every task's texts; it and the caches only save work, no result depends on them.
"""

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import arrow_schema, per_document, text_of

PRE_TOKEN = re.compile(" *[^ ]+| +")
#: Entries of the broadcast table; of a worker's cache; of one task's summary; pre-tokens longer than this aren't kept.
TABLE, CACHE, SUMMARY, LONGEST = 32_768, 400_000, 2_000, 48


def pre_tokens(text: str) -> list[str]:
    """What the tokenizer sees as words: without its first space, which the tokenizer puts before every text."""
    text = text.replace("▁", " ")  # the tokenizer's own sign for a space
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return [x[1:] if x != " " else x for x in PRE_TOKEN.findall(" " + text)]
    return text.split(" ") if text else []


def encoder(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    # one space alone stands for itself: it has no word behind it
    return lambda word: 1 if word == " " else len(model.encode(word))


class Lengths(dict):
    """Pre-token -> tokens. Misses are encoded and kept until the cache is full, when it starts anew."""

    def __init__(self, frequent: dict, path: str):
        super().__init__(frequent)
        self.frequent, self.path, self.encode = frequent, path, None

    def __missing__(self, word):
        self.encode = self.encode or encoder(self.path)
        n = self.encode(word)
        if len(word) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n


#: Of this worker process, by tokenizer: tasks that follow find them warm.
_caches: dict = {}


def frequent_pre_tokens(texts: DataFrame, size=TABLE) -> list[str]:
    """The most frequent pre-tokens by the summaries of all tasks: at most `size` strings of at most LONGEST characters."""
    schema = arrow_schema("word string,n long")

    def summary(batches):
        seen = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(pre_tokens(text))
            if len(seen) > 40 * SUMMARY:  # counts of the rest are lost here; the table only saves work
                seen = Counter(dict(seen.most_common(10 * SUMMARY)))
        top = [x for x in seen.most_common(SUMMARY) if len(x[0]) <= LONGEST]
        yield pa.record_batch([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], schema=schema)

    rows = texts.select("text").mapInArrow(summary, "word string,n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in rows.orderBy(F.desc("n"), "word").limit(size).collect()]


def token_counts(df: DataFrame, tokenizer: str, limit: int, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    `tokenizer` is the path of a sentencepiece model on every executor. A null text counts as empty: 0 bytes, 0 tokens.
    Rows are counted on their own, so repeated rows and null ids come out as often as they came in; other columns are
    ignored. Long texts are counted whole; a pre-token too long for the cache is encoded each time.
    """
    texts = text_of(df, id_col, text_col)
    encode = encoder(tokenizer)
    sent = df.sparkSession.sparkContext.broadcast({w: encode(w) for w in frequent_pre_tokens(texts)})

    def make():
        if tokenizer not in _caches:
            _caches[tokenizer] = Lengths(sent.value, tokenizer)
        length = _caches[tokenizer].__getitem__

        def row(text):
            n = sum(map(length, pre_tokens(text)))
            return len(text.encode()), n, n > limit

        return row

    return per_document(texts, "n_bytes long,n_tokens long,over_limit boolean", make)
