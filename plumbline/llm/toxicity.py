"""Toxicity by noisy-channel deobfuscation.

A character language model is counted over all texts. Words written in look-alike signs, with repeated letters or with
signs between their letters become a lattice of what each sign may stand for; Viterbi search under the model finds the
likeliest words behind them. Restored words are scored by how toxic the labelled documents are that hold them (or words
that begin like them), and a document by its two most telling words, through a logistic curve.

The rows to learn from are halved by their id: one half gives the word weights, the other the curve, so that the curve
sees weights as they do on new documents. Neither labels nor ids are inputs of a score.
"""

import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import WORD, arrow_schema, durable, per_document, text_of

#: Letters the language model knows; 0 stands for anything between words, the last code for other letters.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß"
SIZE = 64
OTHER = SIZE - 1
CODES = {c: i for i, c in enumerate(LETTERS, 1)}
#: What a sign may stand for beside itself.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "¡": "i", "(": "c", "*": "aeiou"}
BETWEEN = frozenset(" \t.-_*/'~,:;")
SWAPPED, DROPPED, DIGIT_KEPT, SPACE_KEPT = 1.0, 0.5, 3.0, 4.0
EDGES = ".,;:?\"'…()[]{}«»“”‘’¿"
RUN = re.compile(r"([^\W\d_])\1\1")
SIGN = re.compile(r"[0-9@$!|+€¡(*]")
LETTER = re.compile(r"[^\W\d_]")
DOTTED = re.compile(r"[^\W_](?:[.\-_*/'~][^\W_]){2,}")
# what stands between letters is never a letter itself, so that no stretch can be cut in two ways
SPACED = re.compile(r"(?<![^\x20\x09-\x0d])(?:[^\W_]|[@$!|])(?:[ \t.\-_*/]{1,3}(?:[^\W_]|[@$!|])){2,}(?![^\x20\x09-\x0d])")
#: Fingerprints of readings: modulus and base; paths are ordered by score, then fingerprint.
PRIME, BASE = (1 << 61) - 1, 1_000_003
ORDER = itemgetter(0, 1)
#: Hash buckets of the word weights (4 bytes each are broadcast), blocks they are summed in, weight of the prior in rows,
#: entries of a worker's cache, and the best readings of an obfuscated word that are scored.
BUCKETS, BLOCKS, PRIOR, CACHE, READINGS = 1 << 21, 64, 5.0, 400_000, 3
#: Labelled rows that are learned from, about: of more, a part by the hash of their id. They are broadcast.
LABELS = 60_000


# ---- the language model

#: Characters counted at a time.
SLICE = 1 << 19
_table = np.zeros(0x180, np.int32)
for _c, _i in CODES.items():
    _table[ord(_c)] = _i


def trigram_counts(df: DataFrame) -> np.ndarray:
    """Counts of letter triples over all texts; each task sends those it met, 64^3 numbers at most reach the driver."""
    schema = arrow_schema("gram int,n long")

    def run(batches):
        total = np.zeros(SIZE**3, np.int64)

        def count(text):
            points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
            codes = np.where(points < len(_table), _table[np.minimum(points, len(_table) - 1)], np.where(points >= 0x370, OTHER, 0).astype(np.int32))
            if len(codes) > 2:
                np.add(total, np.bincount(codes[:-2] * (SIZE * SIZE) + codes[1:-1] * SIZE + codes[2:], minlength=SIZE**3), out=total)

        for batch in batches:
            held, size = [], 0
            for text in batch.column(0).to_pylist():
                if len(text) > SLICE:  # pieces share two letters, so that each triple counts once
                    text = f"\n{text}\n"
                    for at in range(0, len(text) - 2, SLICE):
                        count(text[at : at + SLICE + 2])
                    continue
                held.append(text)
                size += len(text)
                if size >= SLICE:
                    count("\n" + "\n".join(held) + "\n")
                    held, size = [], 0
            count("\n" + "\n".join(held) + "\n")
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met, pa.int32()), pa.array(total[met])], schema=schema)

    rows = df.select("text").mapInArrow(run, "gram int,n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE**3)
    out[rows["gram"].to_numpy(int)] = rows["n"].to_numpy(float)
    return out.reshape(SIZE, SIZE, SIZE)


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), triples backed by pairs and single letters."""
    single = counts.sum((0, 1)) + 1.0
    single /= single.sum()
    pairs = counts.sum(0)
    pair = (pairs + 10 * single) / (pairs.sum(1, keepdims=True) + 10)
    return np.log((counts + 5 * pair[None]) / (counts.sum(2, keepdims=True) + 5)).astype(np.float32)


# ---- the lattice


def lattice(text: str) -> list[list[tuple[str, float]]]:
    """For each sign, or run of one letter, what it may stand for and at what cost."""
    slots, i = [], 0
    while i < len(text):
        c = text[i]
        n = 1
        while i + n < len(text) and text[i + n] == c:
            n += 1
        if c in BETWEEN:
            slots.append([("", 0.0)] + ([(" ", SPACE_KEPT)] if c in " \t" else []) + [(x, SWAPPED) for x in LOOKS.get(c, "")])
        elif c in LOOKS:
            one = [(x, SWAPPED) for x in LOOKS[c]] + ([(c, DIGIT_KEPT)] if c.isdigit() else [])
            slots += [one] * n if n < 3 else [one]
        elif n > 2:
            slots.append([(c, DROPPED), (c + c, DROPPED)])
        else:
            slots += [[(c, 0.0)]] * n
        i += n
    return slots


def decode(text: str, model: np.ndarray, readings=READINGS) -> list[str]:
    """The likeliest readings of an obfuscated string: Viterbi over its lattice, the state being the last two letters.

    A path is its score, a fingerprint of its text and its last piece with the path before it: no text is copied on the
    way, so the work grows with the length of the string.
    """
    steps: dict = {}

    def step(state, piece):
        (x, y), gain = state, 0.0
        for c in piece:
            z = 0 if c == " " else CODES.get(c, OTHER if c.isalpha() else 0)
            gain += float(model[x, y, z])
            x, y = y, z
        print_ = 0
        for c in piece:
            print_ = print_ * BASE + ord(c) + 1
        steps[state, piece] = out = (x, y), gain, BASE ** len(piece), print_
        return out

    def best(paths):
        paths.sort(key=ORDER, reverse=True)
        kept, met = [], set()
        for path in paths:
            if path[1] not in met:
                met.add(path[1])
                kept.append(path)
                if len(kept) == readings:
                    break
        return kept

    beams = {(0, 0): [(0.0, 0, None)]}
    for options in lattice(text):
        grown = {}
        for state, paths in beams.items():
            for piece, cost in options:
                to, gain, shift, more = steps.get((state, piece)) or step(state, piece)
                into = grown.setdefault(to, [])
                for score, seen, path in paths:
                    into.append((score + gain - cost, (seen * shift + more) % PRIME, (path, piece) if piece else path))
        beams = {state: best(paths) for state, paths in grown.items()}
    done = best([(score + float(model[a, b, 0]), seen, path) for (a, b), paths in beams.items() for score, seen, path in paths])
    out = []
    for _, _, path in done:
        pieces = []
        while path:
            path, piece = path
            pieces.append(piece)
        out.append("".join(reversed(pieces)))
    return out


def readings_of(token: str, model: np.ndarray) -> list[str]:
    """What a lower-case token may say: itself without its edges, and its decoded readings if it looks obfuscated."""
    core = token.strip(EDGES)
    plain = core.rstrip("!*+")
    if not LETTER.search(core):
        return []
    if RUN.search(core) or DOTTED.search(core) or (SIGN.search(core) and plain.isalpha() is False):
        return [core, *decode(plain, model)]
    return [plain]


def spaced(text: str, model: np.ndarray) -> list[str]:
    """Words spelt letter by letter with signs between."""
    out = []
    for m in SPACED.finditer(text):
        if len(set(m[0])) > 3:
            out += [w for r in decode(m[0], model) for w in r.split()]
    return out


def features(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    return [xxhash.xxh32_intdigest(f"{k}{word[:k]}") % BUCKETS for k in (3, 4, 5, 6) if len(word) > k] + [xxhash.xxh32_intdigest(f"w{word}") % BUCKETS]


class Cache(dict):
    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, token):
        out = self.of(token)
        if len(token) <= 48:
            if len(self) >= CACHE:
                self.clear()
            self[token] = out
        return out


# ---- learning and scoring


def fold(id_col: str):
    """The part of four that a row belongs to by its id (null: as an empty string)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def word_weights(rows: DataFrame, model) -> np.ndarray:
    """Log-odds of a toxic document per bucket, over `rows` (text, toxic); summed by blocks of buckets, none at the driver."""
    schema = arrow_schema("block int,ids binary,toxic binary,rows binary")
    width = BUCKETS // BLOCKS

    def run(batches):
        both = np.zeros((2, BUCKETS), np.int32)
        buckets = Cache(lambda t: [f for w in readings_of(t, model.value) for f in features(w)])
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text.lower()
                met = {f for t in set(WORD.findall(text)) for f in buckets[t]} | {f for w in spaced(text, model.value) for f in features(w)}
                met = np.fromiter(met, np.int64, len(met))
                both[1, met] += 1
                if toxic:
                    both[0, met] += 1
        out = []
        for block in range(BLOCKS):
            part = both[:, block * width : (block + 1) * width]
            ids = np.flatnonzero(part[1]).astype(np.int32)
            if len(ids):
                out.append((block, ids.tobytes(), part[0, ids].tobytes(), part[1, ids].tobytes()))
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 4, schema.types)], schema=schema)

    share = rows.agg(F.avg("toxic")).first()[0]
    if share is None:
        return np.zeros(BUCKETS, np.float32)
    share = min(max(float(share), 1e-3), 1 - 1e-3)
    end = arrow_schema("block int,weights binary")

    def total(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, block = np.zeros((2, width)), None
        for part in parts:
            for block, ids, toxic, n in zip(*(c.to_pylist() for c in part.columns)):
                ids = np.frombuffer(ids, np.int32)
                both[0, ids] += np.frombuffer(toxic, np.int32)
                both[1, ids] += np.frombuffer(n, np.int32)
        odds = np.log((both[0] + PRIOR * share) / (both[1] - both[0] + PRIOR * (1 - share))) - np.log(share / (1 - share))
        odds[both[1] == 0] = 0
        yield pa.record_batch([pa.array([block], pa.int32()), pa.array([odds.astype(np.float32).tobytes()])], schema=end)

    summed = rows.mapInArrow(run, "block int,ids binary,toxic binary,rows binary").groupBy("block").applyInArrow(total, "block int,weights binary")
    out = np.zeros(BUCKETS, np.float32)
    for r in summed.toLocalIterator():
        out[r.block * width : (r.block + 1) * width] = np.frombuffer(r.weights, np.float32)
    return out


def logistic(cells: list[tuple[float, float, float, int]], rounds=40) -> np.ndarray:
    """Weights (1, first, second) of a ridge logistic curve over (first, second, label, rows) cells."""
    if not cells:
        return np.array([-20.0, 0.0, 0.0])
    first, second, y, n = np.array(cells, float).T
    x = np.stack([np.ones_like(first), first, second], 1)
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - 0.01 * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3)
        step = np.linalg.solve(curve, slope)
        w += step / max(1.0, np.abs(step).max() / 4)
    return w


def sample(labels: DataFrame, most: int) -> DataFrame:
    """About `most` labelled documents at most, chosen by the hash of their id; a document is toxic if any label says so."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    parts = 1 << 30
    return known if n <= most else known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < parts * most // n)


def toxicity(df: DataFrame, labels: DataFrame, threshold=0.3, held_fold=2, most_labels=LABELS, id_col="doc_id", text_col="text", key_col=None) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold); and row_key, `key_col` of df, if given.

    The classifier is fitted on a sample of about `most_labels` labelled rows; the language model on all texts.

    `labels` has doc_id and toxic (0 or 1; null: no label; a document labelled twice is toxic if either says so). Rows in
    fold `held_fold` by their id are never learned from. A null or empty text, and any row when there are no labels,
    gets the score of a text without telling words. Repeated rows and null ids (never held out) are each scored.
    """
    spark = df.sparkSession
    texts = text_of(df, id_col, text_col, key_col)
    model = spark.sparkContext.broadcast(language_model(trigram_counts(texts)))  # 64^3 numbers
    known = F.broadcast(sample(labels.filter(fold("doc_id") != held_fold), most_labels))  # two numbers a row
    weights_folds = [f for f in range(4) if f != held_fold][:2]
    learn = texts.filter(fold("doc_id").isin(weights_folds)).join(known, "doc_id").select("text", "toxic")
    weights = spark.sparkContext.broadcast(word_weights(learn, model))  # BUCKETS numbers

    def make():
        weight = weights.value
        telling = Cache(lambda t: max((float(weight[f]) for w in readings_of(t, model.value) for f in features(w)), default=0.0))

        def row(text):
            text = text.lower()
            found = [telling[t] for t in set(WORD.findall(text))]
            found += [float(weight[f]) for w in spaced(text, model.value) for f in features(w)]
            found.sort(reverse=True)
            return max(found[0], 0.0) if found else 0.0, max(found[1], 0.0) if len(found) > 1 else 0.0

        return row

    key = ["row_key"] if key_col else []
    told = durable(per_document(texts, "first double,second double", make, *key))
    fitted = told.filter(~fold("doc_id").isin([*weights_folds, held_fold])).join(known, "doc_id")
    cells = fitted.groupBy(F.round("first", 1).alias("a"), F.round("second", 1).alias("b"), "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    w = logistic([(r.a, r.b, r.toxic, r.n) for r in cells])
    score = 1 / (1 + F.exp(-(F.lit(float(w[0])) + F.lit(float(w[1])) * F.col("first") + F.lit(float(w[2])) * F.col("second"))))
    told = told.select("doc_id", (fold("doc_id") == held_fold).alias("held_out"), score.alias("score"), *key)
    return told.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *key)
