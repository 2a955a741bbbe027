"""Packing by cutting-stock column generation.

Every document becomes token ids and is cut into whole sequences and one rest. The rests' lengths, in steps of `grain`,
are the order list of a cutting-stock problem: a linear program over patterns (how many pieces of each length share a
sequence), whose columns a knapsack dynamic program prices; it sees the length histogram only, at most length/grain
numbers. Rounded patterns become a table of rank ranges per length, and ranked pieces look up their sequence in it.
"""

import zlib
from collections import Counter
from string import ascii_letters, digits
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.llm.common import arrow_schema, batch_of, durable, text_of
from plumbline.operators.scale import positions

#: Entries of a worker's newer words (it keeps as many older ones), the longest word it keeps, the bytes of text whose
#: distinct words are looked up together, and the words of one call of the tokenizer.
CACHE, LONGEST, GROUP, CALL = 300_000, 48, 4 << 20, 2_000
#: Kinds of bytes: ASCII white space, signs that may end a word, ASCII letters and digits (others: 0); and A-Z as a-z.
SPACE, SIGN, LETTER = 1, 2, 3
KIND, LOWER = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
for _kind, _bytes in (SPACE, b" \t\n\v\f\r"), (SIGN, b".,;:!?%#$&*|"), (LETTER, (ascii_letters + digits).encode()):
    KIND[list(_bytes)] = _kind
LOWER[65:91] += 32


def byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write each byte as: itself if it prints, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, in lower case, and how many are of each text.

    Signs that end a word behind an ASCII letter or digit are a word of their own.
    """
    texts = texts.cast(pa.binary())
    whole = b"\n".join([*texts.to_numpy(zero_copy_only=False), b""])
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1) - 1
    raw = np.frombuffer(whole, np.uint8)
    data, kind = LOWER[raw], KIND[raw]
    if b"<|" in whole:
        for text in np.unique(np.searchsorted(ends, np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|"))))):
            own = slice(ends[text - 1] + 1 if text else 0, ends[text])
            data[own] = raw[own]
    inside, sign = kind != SPACE, kind == SIGN
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins, behind = (np.flatnonzero(x) + 1 for x in (sign[1:] > sign[:-1], sign[:-1] > sign[1:]))
    first[begins[(kind[begins - 1] == LETTER) & (kind[behind[len(behind) - len(begins) :]] == SPACE)]] = True
    at, body = np.flatnonzero(first), data[inside]
    offsets = np.append(np.cumsum(inside, dtype=np.int32)[at] - 1, len(body)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
    return words, np.diff(np.searchsorted(at, ends), prepend=0)


class WordIds(dict):
    """Word (UTF-8) -> its token ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its words; nor does it
    merge a letter or digit with a sign behind it, so words are encoded without the signs that end them. It takes a-z
    and A-Z alike, but for the names of its special tokens. Words of lower-case letters pass its normalizer and splitter
    unchanged: many of them go through its merges in one call without these.
    """

    def __init__(self, path):
        super().__init__()
        from tokenizers import Tokenizer, pre_tokenizers

        self.model, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merges.normalizer, self.merges.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        suffix, vocabulary = self.model.model.end_of_word_suffix, self.model.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.long, self.older, self.letters = [], {}, byte_letters() | {ord(" "): " "}

    def words(self, text: str) -> list[bytes]:
        return words_in(pa.array([text]))[0].to_pylist()

    def encode(self, words: list[bytes]) -> None:
        """Take in words that are not known."""
        plain, accented, other = [], [], []
        for w in words:
            if w.isalpha() and w.islower():  # of a-z
                plain.append(w)
            else:
                text = w.decode()
                (accented if text.isalpha() and text == text.lower() and is_normalized("NFC", text) else other).append(w)
        for kind in plain, accented:
            for i in range(0, len(kind), CALL):
                part = kind[i : i + CALL]
                text = b" ".join(part).decode("latin-1")
                found, = self.merges.encode_batch_fast([text if kind is plain else text.translate(self.letters)], add_special_tokens=False)
                ids = np.array(found.ids, "<u4")
                ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
                if len(ends) == len(part):
                    self.update(zip(part, map(ids.tobytes().__getitem__, map(slice, [0, *ends], ends))))
                else:  # a vocabulary that does not mark where words end
                    other += part
        for i in range(0, len(other), CALL):
            part = other[i : i + CALL]
            for w, found in zip(part, self.model.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                self[w] = np.array(found.ids, "<u4").tobytes()

    def learn(self, words) -> None:
        """After this all `words` (distinct) are here; those too long to keep are gone with the next call."""
        for w in self.long:
            self.pop(w, None)
        if len(self) > CACHE:
            self.older = dict(self)
            self.clear()
        ask = []
        for w in [w for w in words if w not in self]:
            known = self.older.get(w)
            if known is None:
                ask.append(w)
            else:
                self[w] = known
        self.encode(ask)
        self.long = [w for w in ask if len(w) > LONGEST]


#: Of this worker process, by tokenizer.
_words: dict = {}


def cut_pieces(df: DataFrame, tokenizer: str, end_id: int, length: int, id_col="doc_id", text_col="text", with_ids=False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens: whole sequences first, then what is left of a document."""
    ddl = "doc_id long,start long,length long,ids_crc32 long,doc_tokens long" + ",ids binary" * with_ids
    schema = arrow_schema(ddl)

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        if tokenizer not in _words:
            _words[tokenizer] = WordIds(tokenizer)
        known = _words[tokenizer]

        def pieces(doc_ids, texts):
            words, per_text = words_in(texts)
            coded = words.dictionary_encode()
            distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            known.learn(distinct)
            found = list(map(known.__getitem__, distinct))
            n = np.fromiter(map(len, found), np.int64, len(found)) // 4
            begin, place = np.cumsum(n) - n, coded.indices.to_numpy()
            ends = np.cumsum(n[place])
            take = np.repeat(begin[place] - ends + n[place], n[place]) + np.arange(ends[-1] if len(ends) else 0)
            last = np.concatenate([[0], ends])[np.cumsum(per_text)]  # where documents end
            ids = memoryview(np.insert(np.frombuffer(b"".join(found), "<u4")[take], last, end_id).tobytes())
            rows, first = [], 0
            for doc_id, behind in zip(doc_ids.to_pylist(), (last + np.arange(1, len(last) + 1)).tolist()):
                for at in range(first, behind, length):
                    piece = ids[4 * at : 4 * min(at + length, behind)]
                    rows.append((doc_id, at - first, len(piece) // 4, zlib.crc32(piece), behind - first, *([bytes(piece)] if with_ids else [])))
                first = behind
            return batch_of(schema, rows).to_batches()

        for batch in batches:
            size = pc.binary_length(batch.column(1)).to_numpy().astype(np.int64)
            group = (np.cumsum(size) - size) // GROUP
            cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1)).tolist() if len(group) else []
            for a, b in zip(cuts, cuts[1:]):
                yield from pieces(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a))

    return text_of(df, id_col, text_col).mapInArrow(run, ddl)


def knapsack(value: np.ndarray, width: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of widths within `room`: its value, how many of each."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for space in range(1, room + 1):
        best[space] = best[space - 1]
        fits = int(np.searchsorted(width, space, "right"))
        if fits:
            got = best[space - width[:fits]] + value[:fits]
            top = int(got.argmax())
            if got[top] > best[space]:
                best[space], choice[space] = got[top], top
    counts, space = np.zeros(len(width), int), room
    while space > 0:
        if choice[space] < 0:
            space -= 1
        else:
            counts[choice[space]] += 1
            space -= width[choice[space]]
    return best[room], counts


def first_fit(width: np.ndarray, need: np.ndarray, room: int) -> list[tuple[int, np.ndarray]]:
    """(copies, pieces of each width) by first fit in decreasing order, in runs of equal sequences."""
    runs = []  # [room left, copies, pieces]
    for i in reversed(range(len(width))):
        w, todo, grown = int(width[i]), int(need[i]), []
        for left, copies, pieces in runs:
            per = min(left // w, todo)
            if per:
                all_of = min(copies, todo // per)
                todo -= all_of * per
                more = pieces.copy()
                more[i] += per
                grown.append([left - per * w, all_of, more])
                copies -= all_of
            if copies:
                grown.append([left, copies, pieces])
        per = room // w
        for n, copies in ((per, todo // per), (todo % per, 1)):
            if n and copies:
                pieces = np.zeros(len(width), int)
                pieces[i] = n
                grown.append([room - n * w, copies, pieces])
        runs = grown
    return [(copies, pieces) for _, copies, pieces in runs]


def patterns(demand: dict[int, int], room: int, gap=0.001) -> list[tuple[int, dict[int, int]]]:
    """(copies, width -> pieces) that hold exactly `demand` (width -> pieces) in sequences of `room`, in close to the fewest.

    Revised simplex from one pattern per width. Columns come from a pool, which first fit begins, and when none of it
    improves from the knapsack, until it finds none either or the solution is within `gap` of the sequences that prices
    prove necessary. The rounded-down solution takes nearly all pieces; first fit puts what is left.
    """
    width = np.array(sorted(demand))
    need = np.array([demand[w] for w in width])
    m = len(width)
    simple = first_fit(width, need, room)
    pool = np.array([pieces for _, pieces in simple], float)
    columns = np.diag(room // width).astype(float)
    inverse = np.diag(1.0 / (room // width))
    centre, bound = width / room, need @ width / room  # prices that are feasible, and the sequences they prove necessary
    for step_number in range(40 * m):
        if step_number % 100 == 99:
            inverse = np.linalg.inv(columns)
        have, dual = inverse @ need, inverse.sum(axis=0)
        if have.sum() <= bound * (1 + gap):
            break
        worth = pool @ dual
        counts = pool[int(worth.argmax())]
        if worth.max() <= 1 + 1e-7:
            for prices in (0.7 * centre + 0.3 * np.maximum(dual, 0), np.maximum(dual, 0)):  # smoothed prices wander less
                value, counts = knapsack(prices, width, room)
                if need @ prices / value > bound:
                    centre, bound = prices / value, need @ prices / value
                if dual @ counts > 1 + 1e-7:
                    break
            else:
                break
            pool = np.vstack([pool, counts])
        move = inverse @ counts
        ratio = np.where(move > 1e-9, np.maximum(have, 0) / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = counts
        pivot = inverse[out] / move[out]
        inverse -= np.outer(move, pivot)
        inverse[out] = pivot
    found, left = [], need.copy()
    for copies, column in zip(np.floor(inverse @ need + 1e-9).astype(int), columns.T.astype(int)):
        copies = min([int(copies), *(left[column > 0] // column[column > 0])])
        if copies > 0:
            left -= copies * column
            found.append((int(copies), column))
    found += first_fit(width, left, room)
    if sum(c for c, _ in found) > sum(c for c, _ in simple):
        found = simple
    return [(copies, {int(width[i]): int(pieces[i]) for i in np.flatnonzero(pieces)}) for copies, pieces in found]


def rank_ranges(made: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int]]:
    """(width, first rank, rank behind the last, pieces per sequence, first sequence) in the order of the patterns."""
    used, rows, base = Counter(), [], 0
    for copies, pieces in made:
        for w, per in pieces.items():
            rows.append((w, used[w], used[w] + per * copies, per, base))
            used[w] += per * copies
        base += copies
    return rows


def assign(pieces: DataFrame, length: int, grain: int) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `length`."""
    spark = pieces.sparkSession
    sized = pieces.withColumn("_w", F.ceil(F.col("length") / grain).cast("int")).withColumn("_h", F.xxhash64("doc_id", "start"))
    demand = {r["_w"]: r["n"] for r in sized.groupBy("_w").agg(F.count(F.lit(1)).alias("n")).collect()}  # length / grain rows
    ranges = rank_ranges(patterns(demand, length // grain)) if demand else []
    table = spark.createDataFrame(ranges, "_w int, _from long, _to long, _per long, _base long")
    order = ["_h", "doc_id", "start", "ids_crc32", "length"]
    bucket = (F.expr("shiftright(_h, 54)"), F.expr("shiftright(_h, 48)"))
    ranked = positions(sized, [F.col(c) for c in order], bucket, keys=("_w",), name="_rank").withColumn("_rank", F.col("_rank") - 1)
    # a few ranges for each of length / grain widths, whatever the input's size
    met = ranked.join(F.broadcast(table), "_w").filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    placed = met.withColumn("sequence_id", (F.col("_base") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_per"))).cast("long"))
    before = W.partitionBy("sequence_id").orderBy(F.desc("length"), *order).rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select(*pieces.columns, "sequence_id", "offset")


def pack(df: DataFrame, tokenizer: str, end_id=1, length=2048, grain=8, id_col="doc_id", text_col="text", with_ids=False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (with_ids: and its ids as bytes).

    A null or empty text is one piece with the end id. Repeated rows and null ids are packed as often as they occur;
    an empty table gives no rows; other columns are ignored. `length` must be a multiple of `grain`.
    """
    return assign(durable(cut_pieces(df, tokenizer, end_id, length, id_col, text_col, with_ids)), length, grain)
