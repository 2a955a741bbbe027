"""Periodic runs of words by grammar compression.

Word ids are compressed by Re-Pair in rounds: a round replaces, more frequent ones first, the neighbouring pairs that
occur twice or more by new symbols, until every pair is unique; what remains is halved into a balanced tree. A run lies
across the boundary of the smallest symbol that holds it, so for each symbol the runs across its boundary are computed
once, inside its expansion, and carried to every place where the symbol was derived. Pieces that lie inside a longer run
of their period are merged into it: the maximal runs remain.

Equal blocks are found by fingerprints, and every run is then measured on the word ids themselves.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import WORD, arrow_schema, text_of

#: A run has at least TIMES periods and LEAST words.
TIMES, LEAST = 4, 6
#: Words compressed together, and (symbol, period) pairs looked at together.
GROUP, TESTS = 1 << 18, 1 << 21
ODD = np.uint64(0x9E3779B97F4A7C15)


# ---- the grammar


def first_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the distinct key, how often each distinct key occurs), both by sorting."""
    _, number, times = np.unique(keys, return_inverse=True, return_counts=True)
    return number, times


def symbols(ids: np.ndarray, owner: np.ndarray):
    """Derived places (begin, boundary, end, symbol) of all symbols over the words of several documents; `owner` ascends.

    A symbol's places have equal expansions. Documents share no symbols.
    """
    n = len(ids)
    sym, begin, end, doc = ids.astype(np.int64), np.arange(n), np.arange(1, n + 1), owner
    live, fresh, out = np.ones(max(n - 1, 0), bool), int(ids.max()) + 1 if n else 0, []

    def derived(at, names):
        out.append((begin[at], begin[at + 1], end[at + 1], names))

    while len(sym) > 1:
        at = np.flatnonzero(live & (doc[:-1] == doc[1:]))
        if not len(at):
            break
        # pairs are numbered within their document
        pair, _ = first_of(sym[at] * fresh + sym[at + 1]) if fresh < 1 << 31 else first_of(first_of(sym)[0][at] * n + first_of(sym)[0][at + 1])
        kind, times = first_of(pair * n + doc[at])
        often = times[kind]
        live[:] = False
        keep = often > 1
        at, kind, often = at[keep], kind[keep], often[keep]
        live[at] = True
        if not len(at):
            break
        # of overlapping pairs the more frequent one is replaced, of equally frequent ones the one first numbered
        weight = often * (len(times) + 1) - kind
        rank = np.zeros(len(sym) + 1, np.int64)
        rank[at + 1] = weight  # one place for a pair before the first
        mine, before, behind = rank[at + 1], rank[at], np.append(rank, 0)[at + 2]
        # in a stretch of one pair over and over, every second is replaced
        same = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (kind[1:] != kind[:-1])]))
        offset = np.arange(len(at)) - np.repeat(same, np.diff(np.append(same, len(at))))
        head = np.repeat(before[same], np.diff(np.append(same, len(at))))
        last = np.append(same[1:], len(at)) - 1
        tail = np.repeat(behind[last], np.diff(np.append(same, len(at))))
        taken = (offset % 2 == 0) & (head < mine) & (tail < mine)
        if not taken.any():  # a rising row of weights always has a top, so this does not happen
            break
        at, kind = at[taken], kind[taken]
        names, _ = first_of(kind)
        derived(at, names + fresh)
        sym[at], end[at] = names + fresh, end[at + 1]
        fresh += int(names.max()) + 1
        gone = np.zeros(len(sym), bool)
        gone[at + 1] = True
        touched = np.zeros(len(sym) + 1, bool)  # new pairs: before and behind a new symbol
        touched[at] = touched[np.maximum(at - 1, 0)] = True
        old = np.append(live, False)
        stay = ~gone
        was_new = np.zeros(len(sym), bool)
        was_new[at] = True
        sym, begin, end, doc, old, was_new = sym[stay], begin[stay], end[stay], doc[stay], old[stay], was_new[stay]
        live = (old[:-1] | was_new[:-1] | was_new[1:])[: len(sym) - 1]
    # what remains is halved
    while len(sym) > 1:
        number = np.arange(len(sym)) - np.searchsorted(doc, doc)
        at = np.flatnonzero((doc[:-1] == doc[1:]) & (number[:-1] % 2 == 0))
        if not len(at):
            break
        derived(at, fresh + np.arange(len(at)))
        fresh += len(at)
        end[at] = end[at + 1]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        begin, end, doc, sym = begin[stay], end[stay], doc[stay], sym[stay]
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*out) if out else [[]] * 4))


# ---- runs across boundaries


class Prints:
    """Fingerprints of blocks of words: sums of powers, modulo 2^64."""

    def __init__(self, ids: np.ndarray):
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x165667B19E3779F9)
        x ^= x >> np.uint64(32)
        self.power = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(len(ids), ODD, np.uint64))])
        self.upto = np.concatenate([[np.uint64(0)], np.cumsum(x * self.power[:-1], dtype=np.uint64)])

    def doubled(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the block of q words at `at` equals the one behind it."""
        a, b, c = self.upto[at], self.upto[at + q], self.upto[at + 2 * q]
        return (b - a) * self.power[q] == c - b


def across(ids: np.ndarray, prints: Prints, begin: int, boundary: int, end: int, periods: list[int]):
    """Runs (start, end, period) within begin..end across the boundary, of the periods (ascending) whose blocks are doubled there."""
    found = []
    for q in periods:
        # blocks behind and before the boundary, but those that a shorter period dividing this one covers: same stretch
        sides = [at for at in (boundary, boundary - 2 * q) if begin <= at and at + 2 * q <= end]
        sides = [at for at in sides if not any(q % p == 0 and s <= at and at + 2 * q <= e for s, e, p in found)]
        if not sides:
            continue
        differ = np.flatnonzero(ids[begin : end - q] != ids[begin + q : end]) + begin
        for at in sides:  # from the last word unlike the one a period on before the block to the next such word
            k = int(np.searchsorted(differ, at))
            s = int(differ[k - 1]) + 1 if k else begin
            e = (int(differ[k]) if k < len(differ) else end - q) + q
            # the same stretch under a shorter period is no new run
            if e - s >= max(LEAST, TIMES * q) and s < boundary < e and not any(q % p == 0 and a <= s and e <= b for a, b, p in found):
                found.append((s, e, q))
    return found


def runs_of(ids: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int]]:
    """All maximal runs (start, end, period) over the words of several documents, ordered by start, then period."""
    begin, boundary, end, name = symbols(ids, owner)
    if not len(name):
        return []
    size = end - begin
    order = np.argsort(name, kind="stable")
    order = order[size[order] >= LEAST]
    if not len(order):
        return []
    firsts = np.flatnonzero(np.concatenate([[True], np.diff(name[order]) != 0]))
    stops = np.append(firsts[1:], len(order))
    one = order[firsts]  # a place of each symbol
    prints, most = Prints(ids), size[one] // TIMES
    upto = np.concatenate([[0], np.cumsum(most)])
    hits: dict[int, list[int]] = {}
    low = 0
    while low < len(one):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + TESTS, "right")) - 1)
        for part in range(int(upto[low]), int(upto[high]), TESTS):  # one long symbol: its periods in parts
            test = np.arange(part, min(part + TESTS, int(upto[high])))
            k = np.searchsorted(upto, test, "right") - 1
            q, at = test - upto[k] + 1, one[k]
            m, b, e = boundary[at], begin[at], end[at]
            right = np.flatnonzero(m + 2 * q <= e)
            right = right[ids[m[right]] == ids[m[right] + q[right]]]
            right = right[prints.doubled(m[right], q[right])]
            left = np.flatnonzero(m - 2 * q >= b)
            left = left[ids[m[left] - 1] == ids[m[left] - 1 - q[left]]]
            left = left[prints.doubled(m[left] - 2 * q[left], q[left])]
            for i in np.union1d(right, left).tolist():
                hits.setdefault(int(k[i]), []).append(int(q[i]))
        low = high
    pieces = set()
    for k, periods in hits.items():
        i = int(one[k])
        for s, e, q in across(ids, prints, int(begin[i]), int(boundary[i]), int(end[i]), periods):
            for place in begin[order[firsts[k] : stops[k]]].tolist():  # every place where the symbol was derived
                pieces.add((q, s - int(begin[i]) + place, -(e - int(begin[i]) + place)))
    out, held = [], (0, 0)  # pieces inside a longer run of their period are merged into it
    for q, s, e in sorted(pieces):
        if held[0] != q or -e > held[1]:
            out.append((s, -e, q))
            held = q, -e
    return sorted((s, e, q) for s, e, q in out)


# ---- documents


def planted(words: list[str], doc_id) -> list[str]:
    """The words with the run that the number of one document in ten asks for."""
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def row_of(words: list[str], found: list[tuple[int, int, int]], with_text: bool):
    """The cells of a document with these runs (start, end, period; word numbers of the document)."""
    dropped = np.zeros(len(words) + 1, np.int32)
    for s, e, q in found:
        dropped[s + q] += 1
        dropped[e] -= 1
    kept = " ".join(words[i] for i in np.flatnonzero(np.cumsum(dropped[:-1]) == 0).tolist()) if found else " ".join(words)
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    told = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    longest = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (len(found), *longest, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode("utf-8", "replace")).hexdigest(), *([kept] if with_text else []))


def periodic_runs(df: DataFrame, change=None, with_text=False, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: doc_id, n_runs, start, length, period, exponent_milli (of the longest run), runs_sha256, collapsed_sha256.

    `change(words, doc_id)` may alter a document's words first; `with_text` adds `collapsed`, the words that no run
    repeats, joined by spaces. A null or empty text has no words and no runs. Rows are judged on their own, whole,
    however long: repeated rows and null ids come out as often as they came in; other columns are ignored. Of equally long
    runs the first, then the one of the shorter period, is the longest.
    """
    ddl = "doc_id long,n_runs long,start long,length long,period long,exponent_milli long,runs_sha256 string,collapsed_sha256 string" + ",collapsed string" * with_text
    schema = arrow_schema(ddl)

    def cells(held):
        numbers: dict[str, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for _, ws in held for w in ws), np.int64)
        sizes = np.array([len(ws) for _, ws in held])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        per = [[] for _ in held]
        found = runs_of(ids, np.repeat(np.arange(len(held)), sizes))
        for (s, e, q), k in zip(found, (np.searchsorted(starts, [s for s, _, _ in found], "right") - 1).tolist()):
            per[k].append((s - int(starts[k]), e - int(starts[k]), q))
        rows = [(doc_id, *row_of(ws, mine, with_text)) for (doc_id, ws), mine in zip(held, per)]
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), schema.types)], schema=schema)

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall(text)
                held.append((doc_id, change(words, doc_id) if change else words))
                size += len(words)
                if size >= GROUP:
                    yield cells(held)
                    held, size = [], 0
            if held:
                yield cells(held)

    return text_of(df, id_col, text_col).select("doc_id", "text").mapInArrow(run, ddl)
