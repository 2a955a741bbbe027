"""The training-data operators against brute force, exact round trips and held-out accuracy, on awkward small tables."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

WORDS = re.compile("[^\x20\x09-\x0d]+")
#: Names that operators use inside; input columns of these names must not disturb them.
EXTRA = ["chunk", "node", "key", "n", "size", "bucket", "archive", "cls", "shard", "body", "toxic", "_0"]


def sentence(rng, n, vocabulary=400):
    return " ".join("w" + "".join(rng.choice("abcdefg") for _ in range(1 + i % 5)) + str(rng.randrange(vocabulary)) for i in range(n))


def awkward_rows():
    rng = random.Random(5)
    base, shared = sentence(rng, 120), sentence(rng, 60)
    edited = base.split()
    edited[60] = "OTHER"
    far = [w if i % 9 else "x" + w for i, w in enumerate(base.split())]
    rows = [(10, base), (4, base), (7, " ".join(edited)), (11, " ".join(far)), (10, base), (3, base.upper())]
    rows += [(20, f"{sentence(rng, 30)} {shared} {sentence(rng, 30)}"), (21, f"{sentence(rng, 40)}\n{shared}"), (22, shared), (23, shared + " " + shared)]
    rows += [(30, None), (31, ""), (32, "  \n\t "), (None, None), (None, base), (None, sentence(rng, 50)), (33, "a"), (34, "a b"), (35, "a b"), (36, "A B")]
    rows += [(40, "é日本ﬁ\x00" * 60), (41, "x" + "é日本ﬁ\x00" * 40), (42, "ab " * 400), (43, "\x85\x1c  z")]
    rows += [(50, sentence(rng, 30_000)), (51, "q" * 120_000), (-5, shared)]
    return rows


def frame(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    for c in EXTRA:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def awkward(spark):
    return frame(spark, awkward_rows())


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def sorted_rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def words_of(text):
    return WORDS.findall(text or "")


# ---- 1 near dedup


def brute_components(rows, words, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        ws = words_of((text or "").translate(low))
        k = min(words, len(ws))
        sets.append({tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(d, len(s), least.get(find(i)), d is not None and d == least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_dedup(awkward, words, percent):
    from plumbline.llm.near_dedup import near_dedup

    got = sorted_rows(near_dedup(awkward, words, percent), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute_components(awkward_rows(), words, percent), key=repr)


def test_near_dedup_crowds(spark, monkeypatch):
    """Nodes beyond LEAF branch, and what never gets small is compared in pairs of blocks: no link is lost."""
    from plumbline.llm import near_dedup as nd

    rng = random.Random(1)
    base = sentence(rng, 150).split()
    rows = []
    for i in range(160):
        ws = list(base)
        for _ in range(i % 8):
            ws[rng.randrange(len(ws))] = f"e{rng.random()}"
        rows.append((i, " ".join(ws)))
    rows += [(1000 + i, sentence(rng, 40)) for i in range(60)]
    monkeypatch.setattr(nd, "LEAF", 16)
    monkeypatch.setattr(nd, "DEPTH", 3)
    got = sorted_rows(nd.near_dedup(frame(spark, rows), 3, 85), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute_components(rows, 3, 85), key=repr)


def test_linked_is_exact():
    from plumbline.llm.near_dedup import linked

    rng = np.random.default_rng(3)
    for _ in range(30):
        base = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
        sets = []
        for _ in range(int(rng.integers(2, 30))):
            s = base.copy()
            k = int(rng.integers(0, 14))
            s[rng.integers(0, 60, k)] = rng.integers(0, 1 << 60, k, dtype=np.uint64)
            sets.append(np.unique(s))
        n = len(sets)
        want = np.arange(n)
        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    want[want == max(want[i], want[j])] = min(want[i], want[j])
        assert linked(sets, 85).tolist() == want.tolist()


def test_components(spark):
    from plumbline.llm.components import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (-7, 102), (200, 200)]
    got = dict(sorted_rows(components(spark.createDataFrame(chain, "a long, b long")), "node", "root"))
    assert got == {**{i: 0 for i in range(41)}, 100: -7, 101: -7, 102: -7, -7: -7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 2 suffix dedup


def brute_suffix(rows, window):
    data = [(d, (t or "").encode()) for d, t in rows]
    order = [float("inf") if d is None else d for d, _ in data]
    first = {}
    for o, (_, b) in zip(order, data):
        for p in range(len(b) - window + 1):
            s = b[p : p + window]
            first[s] = min(o, first.get(s, o))
    out = []
    for o, (d, b) in zip(order, data):
        mask = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < o:
                mask[p : p + window] = True
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        out.append((d, len(b), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window", [50, 33])
def test_suffix_dedup(awkward, window, monkeypatch):
    from plumbline.llm import common
    from plumbline.llm.suffix_dedup import suffix_dedup

    monkeypatch.setattr(common, "CHUNK_BYTES", 20_000)
    cols = "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    assert sorted_rows(suffix_dedup(awkward, window), *cols) == sorted(brute_suffix(awkward_rows(), window), key=repr)


def test_windows_are_ranked_at_anchors_alone():
    import pyarrow as pa

    from plumbline.llm.rolling import lowest, windows, windows_at
    from plumbline.llm.suffix_dedup import FIRST, Chunk

    rng = random.Random(1)
    some = [rng.choice(["ab", "abcdefgh é", "q"]) for _ in range(60)]
    texts = ["", "q" * 49, "q" * 50, "q" * 51, *["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for letters in some]]
    for window in (50, 33, 25):
        chunk = Chunk(pa.table({"doc_id": [*range(1, len(texts)), None], "text": texts}), None, window, 3)
        for length in (8, 24, 32, window, FIRST + 2 * chunk.side):
            every, = windows(chunk.data, length)
            at = np.array(sorted(rng.sample(range(len(every)), 500)))
            assert (windows_at(chunk.data, at, length, block=64) == every[at]).all()
        first, last = chunk.starts(np.arange(len(chunk.places)))
        got = [set(range(a, b + 1)) for a, b in zip(first.tolist(), last.tolist())]
        want = []
        for text, base in zip(texts, chunk.base.tolist()):
            data = np.frombuffer(text.encode(), np.uint8)
            assert chunk.data[base : base + len(data)].tobytes() == data.tobytes()
            if len(data) < window:
                continue
            rank, = windows(data, FIRST)
            low = lowest(rank, chunk.width)
            for p in range(len(rank)):
                over = {base + b for b in range(max(0, p - chunk.width + 1), min(p, len(low) - 1) + 1) if low[b] == rank[p]}
                if over:
                    want.append(over)
        assert got == want


def test_suffix_dedup_text(awkward):
    from plumbline.llm.suffix_dedup import suffix_dedup

    rows = suffix_dedup(awkward, 50, with_text=True, carry=["chunk", "text"]).collect()
    assert {r.chunk for r in rows} == {"clash"}
    for r in rows:
        whole, kept = r.text or "", r.cleaned
        assert len(whole.encode()) - r.n_removed <= len(kept.encode()) <= len(whole.encode()) - r.n_removed + 6 * r.n_spans
        if not r.n_removed:
            assert kept == whole


# ---- 3 token counts


def test_token_counts(spark, awkward):
    import sentencepiece

    from plumbline.llm.token_counts import token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    rows = awkward_rows() + [(i, "".join(rng.choice("ab  \n\t▁.é日<s>0") for _ in range(rng.randrange(40)))) for i in range(500)]
    want = [(d, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 100) for d, t in rows]
    assert sorted_rows(token_counts(frame(spark, rows), path, 100), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


# ---- 4 decontamination


def edits(item, text):
    """Least edits between `item` and any passage of `text`."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_decontamination(spark, monkeypatch):
    from plumbline.llm import decontamination as dc

    rng = random.Random(8)
    items = [(i, sentence(rng, 8 + i)) for i in range(6)] + [(90, None), (91, ""), (92, "ab"), (93, items_dup := sentence(rng, 9)), (94, items_dup)]
    rows = [(100, None), (101, ""), (None, items[1][1]), (102, sentence(rng, 80)), (103, items[0][1].upper().replace(" ", "\n "))]
    for i, (_, text) in enumerate(items[:6]):
        for k in range(0, 14, 2):
            passage = list(text)
            for _ in range(k):
                p = rng.randrange(len(passage))
                passage[p : p + 1] = rng.choice(["", "z", passage[p] + "y"])
            rows.append((200 + 20 * i + k, f"{sentence(rng, 20)} {''.join(passage)} {sentence(rng, 10)}"))
    rows.append((103, items[0][1]))
    bench = frame(spark, items, "item_id long, text string")
    got = sorted_rows(dc.contaminated(frame(spark, rows), bench), "doc_id", "item_id", "distance")
    want = []
    for doc_id, text in rows:
        for item_id, item in items:
            a = dc.normal(item or "")
            if len(a) >= dc.Q:
                d = edits(a, dc.normal(text or ""))
                if d <= int(len(a) * 0.1):
                    want.append((doc_id, item_id, d))
            elif a and b" " + a + b" " in b" " + dc.normal(text or "") + b" ":
                want.append((doc_id, item_id, 0))
    assert got == sorted(want, key=repr)
    monkeypatch.setattr(dc, "BLOCK_BYTES", 100)  # the benchmark in blocks
    assert sorted_rows(dc.contaminated(frame(spark, rows), bench), "doc_id", "item_id", "distance") == got


# ---- 5 sharding


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_sharding(awkward, shards):
    from plumbline.llm.sharding import shard

    rows = shard(awkward, shards).collect()
    want = sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in awkward_rows()), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=repr) == want
    held = {}
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        held.setdefault(r.shard, []).append(r)
    largest = max(r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    for s in held.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
        assert abs(sum(r["size"] for r in s) - total / shards) <= largest + 0.002 * total / shards + 1


def test_sharding_near_equal_and_hot(spark):
    from plumbline.llm.sharding import shard

    rows = [(i, "same text here") for i in range(3000)] + [(10_000 + i, f"text {i} " * (1 + i % 7)) for i in range(6000)]
    sizes = {r.shard: r.s for r in shard(frame(spark, rows), 12).groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    mean = sum(sizes.values()) / 12
    assert len(sizes) == 12 and max(abs(s - mean) for s in sizes.values()) < 0.005 * mean


# ---- 6 WARC


def test_warc_round_trip(spark, tmp_path, monkeypatch):
    import gzip

    from plumbline.llm import warc
    from plumbline.llm.common import durable

    monkeypatch.setattr(warc, "CHUNK", 1000)
    rng = random.Random(4)
    big = "".join(chr(rng.randrange(32, 1500)) for _ in range(9000))
    pages = [(1, "http://a", "<p>x</p>"), (5, "http://b", "<p>x</p>"), (3, None, "<p>x</p>"), (7, "http://c\r\nX: y", big), (8, "u", big), (9, "v", big + "\r\n\r\n"),
             (10, "e", ""), (11, "n", None), (None, "z", "<p>x</p>"), (None, "z", "only here"), (12, "r", "twice"), (12, "r", "twice"), (2, "s", "twice")]
    table = durable(warc.write_records(frame(spark, pages, "page_id long, url string, html string")))
    fields = "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    got = sorted_rows(warc.read_records(table), *fields)
    assert sorted_rows(warc.read_records(table, in_order=True), *fields) == got
    top = {}
    for p, _, h in pages:
        if p is not None:
            top[h or ""] = max(p, top.get(h or "", p))
    want = []
    for p, _, h in pages:
        data = (h or "").encode()
        again = p is not None and p < top[h or ""]
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top[h or ""] if again else None))
    assert got == sorted(want, key=repr)
    assert max(len(r.data) for r in table.select("data").collect()) < 100_000  # a chunk, and what the compressor holds back
    files = warc.save_files(table, str(tmp_path)).collect()
    whole = b"".join(gzip.decompress(open(f.path, "rb").read()) for f in files)
    assert whole.count(b"WARC/1.1\r\nWARC-Type:") == len(pages)
    empty = durable(warc.write_records(frame(spark, [], "page_id long, url string, html string")))
    assert warc.read_records(empty).count() == 0


# ---- 7 substring dedup


def brute_words(rows, window):
    docs = [words_of(t) for _, t in rows]
    times = {}
    for ws in docs:
        for i in range(len(ws) - window + 1):
            times[tuple(ws[i : i + window])] = times.get(tuple(ws[i : i + window]), 0) + 1
    out = []
    for (d, _), ws in zip(rows, docs):
        gone = set()
        for i in range(len(ws) - window + 1):
            if times[tuple(ws[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((d, len(ws), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(ws) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [35, 10])
def test_substring_dedup(awkward, window, monkeypatch):
    from plumbline.llm import common
    from plumbline.llm.substring_dedup import substring_dedup

    monkeypatch.setattr(common, "CHUNK_BYTES", 20_000)
    got = sorted_rows(substring_dedup(awkward, window), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute_words(awkward_rows(), window), key=repr)


# ---- 8 packing


def test_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    from plumbline.llm.packing import WordIds

    path = public_tokenizers.path("word_bpe_49k.json")
    model, ids = Tokenizer.from_file(path), WordIds(path)
    rng = random.Random(0)
    signs = [*"abzABZ019'’.,!?)(#é́ÉßİΣσς<|>\t\n   \x1c\x85日ﬁ", "'s", "'RE", "<|endoftext|>", "<|ENDOFTEXT|>", " "]
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(14)))
        words = ids.words(text)
        ids.learn(set(words))
        assert np.frombuffer(b"".join(map(ids.__getitem__, words)), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, text


def test_words_are_split_by_whole_batches(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from plumbline.llm import packing

    rng = random.Random(3)
    signs = [*"abZ09é日.,;!?%#$&*|<>'- \t\n\v\f\r\x1c\x85", "<|", "ab", "  "]
    texts = ["", " ", ",", "a,", "A, B.", "<|A,", "é, 9!!", "a,b ,c"] + ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(800)] + [""]
    words, per_text = packing.words_in(pa.array(["x", *texts]).slice(1))
    want = []
    for t in texts:
        parts = [re.fullmatch(r"(?s)(.*?)((?<=[0-9A-Za-z])[.,;:!?%#$&*|]+)?", w).groups() for w in WORDS.findall(t)]
        found = [p for pair in parts for p in pair if p]
        want.append([p.encode() if "<|" in t else p.encode().lower() for p in found])
    assert words.to_pylist() == [p for ps in want for p in ps]
    assert per_text.tolist() == list(map(len, want))
    # the ids of many words in one call are those of each alone, also where a vocabulary does not mark where words end
    path = public_tokenizers.path("word_bpe_49k.json")
    model, distinct = Tokenizer.from_file(path), sorted(set(words.to_pylist()))
    for call, marked in ((2_000, True), (7, True), (50, False)):
        monkeypatch.setattr(packing, "CALL", call)
        ids = packing.WordIds(path)
        ids.last &= marked
        ids.learn(distinct)
        for w in distinct:
            assert np.frombuffer(ids[w], "<u4").tolist() == model.encode(w.decode(), add_special_tokens=False).ids, w


def test_packing(awkward):
    from tokenizers import Tokenizer

    from plumbline.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rows = pack(awkward, path, end_id=1, length=2048, with_ids=True).collect()
    want = sorted(tuple(model.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in awkward_rows())
    docs, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, tuple(ids.tolist())))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    pieces = sorted(x for v in docs.values() for x in v)
    assert sum(len(p) for _, p in pieces) == sum(map(len, want))
    assert sorted(p for s, p in pieces if s == 0) == sorted(w[:2048] for w in want)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048


def test_patterns_hold_all_pieces():
    from plumbline.llm.packing import patterns

    rng = np.random.default_rng(0)
    for demand in ({1: 3}, {64: 5}, {33: 10, 32: 3}, {int(w): int(n) for w, n in zip(range(1, 65), rng.integers(1, 900, 64))}, {int(w): 1 for w in range(1, 65, 3)}):
        held = {}
        made = patterns(demand, 64)
        for copies, pieces in made:
            assert sum(w * n for w, n in pieces.items()) <= 64
            for w, n in pieces.items():
                held[w] = held.get(w, 0) + copies * n
        assert held == demand
        assert sum(c for c, _ in made) <= 1.25 * sum(w * n for w, n in demand.items()) / 64 + 1 or min(demand) > 16


# ---- 9 quality


def test_quality_rules(awkward):
    from plumbline.llm.quality_rules import quality_rules

    rows = {(r.doc_id, r.n_words): r for r in quality_rules(awkward, with_text=True).collect()}
    for doc_id, text in awkward_rows():
        text = text or ""
        ws = words_of(text)
        r = rows[doc_id, len(ws)]
        windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        again = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)} if len(ws) < 2000 else None
        if again is not None:
            assert r.n_repeat_words == len(again)
            assert r.base_failed == (len(ws) < 50 or 100 * len(again) > 50 * len(ws))
        assert r.word_chars == sum(map(len, ws)) and r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        lines = [x for x in text.split("\n") if words_of(x)]
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert not (r.kept and r.base_failed)


def test_quality_lines():
    from plumbline.llm.quality_rules import clean_lines

    text = "Good words stand here.\nHome | About | Contact | Help\nBUY!! NOW!! CHEAP!!\n\nGood words stand here.\nWe accept all cookies. Fine.\na### b*** c$$$\nplain heading"
    kept, dup, total, lost = clean_lines(text)
    assert kept == ["Good words stand here.", "", "plain heading"] and dup == 1 and lost == total - len("Goodwordsstandhere.plainheading")


# ---- 10 toxicity


def test_toxicity_learns_and_generalises(spark):
    from plumbline.llm.toxicity import toxicity

    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = toxicity(docs.withColumn("toxic", F.lit(7)), labels).join(labels, "doc_id").filter("held_out")
    n, right, caught, toxic = found.agg(F.count("*"), F.sum((F.col("predicted") == F.col("toxic")).cast("int")), F.sum(F.col("predicted") * F.col("toxic")), F.sum("toxic")).first()
    assert right / n > 0.93 and caught / toxic > 0.75  # 4,000 labels, some of them noise
    unlike = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found.select("doc_id", "held_out").take(50)]
    assert all(held for _, held in unlike)


def test_toxicity_awkward(spark, awkward, nothing):
    from plumbline.llm.toxicity import toxicity

    labels = spark.createDataFrame([(10, 1), (4, None), (None, 1), (20, 0), (20, 0), (21, 0), (7, 1)], "doc_id long, toxic int")
    rows = toxicity(awkward, labels).collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((d for d, _ in awkward_rows()), key=repr)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    none = toxicity(awkward, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity(nothing, labels).count() == 0


def test_letter_counts_do_not_depend_on_slices(spark, monkeypatch):
    from plumbline.llm import toxicity as T

    df = spark.createDataFrame([("The Idiot é said ß 日本 stuff" * 9,), ("a",), ("",), ("zz zz ",)], "text string").coalesce(1)
    whole = T.trigram_counts(df)
    monkeypatch.setattr(T, "SLICE", 5)
    inside = T.trigram_counts(df)
    assert whole[:, 1:].sum() and (inside[:, 1:] == whole[:, 1:]).all()  # but for what has a text's end in its middle


def test_deobfuscation():
    from plumbline.llm import toxicity as T

    lexicon = "the idiot and a moron said stupid trash to some pathetic loser clown who is worthless scum " * 50
    codes = np.array([T.CODES.get(c, 0) for c in lexicon])
    model = T.language_model(np.bincount(codes[:-2] * T.SIZE**2 + codes[1:-1] * T.SIZE + codes[2:], minlength=T.SIZE**3).reshape(T.SIZE, T.SIZE, T.SIZE).astype(float))
    for seen, meant in {"1d10t": "idiot", "idiooot": "idiot", "m0r0n": "moron", "tra$h": "trash", "l.o.s.e.r": "loser", "p4thet1c": "pathetic", "st*pid": "stupid", "cl0wn!!": "clown"}.items():
        assert meant in T.readings_of(seen, model), seen
    assert "stupid" in T.spaced("you s t u p i d one", model)
    assert T.readings_of("harmless", model) == ["harmless"] and T.readings_of("1234", model) == []


# ---- empty tables


def test_empty_tables(spark, nothing):
    from plumbline.llm.decontamination import contaminated
    from plumbline.llm.near_dedup import near_dedup
    from plumbline.llm.packing import pack
    from plumbline.llm.quality_rules import quality_rules
    from plumbline.llm.sharding import shard
    from plumbline.llm.substring_dedup import substring_dedup
    from plumbline.llm.suffix_dedup import suffix_dedup
    from plumbline.llm.token_counts import token_counts

    bench = spark.createDataFrame([(1, "some benchmark text")], "item_id long, text string")
    for made in (near_dedup(nothing), suffix_dedup(nothing), token_counts(nothing, public_tokenizers.path("piece_bpe_32k.model"), 9), contaminated(nothing, bench), shard(nothing, 40),
                 substring_dedup(nothing), pack(nothing, public_tokenizers.path("word_bpe_49k.json")), quality_rules(nothing)):
        assert made.count() == 0
    assert contaminated(frame(spark, awkward_rows()), bench.limit(0)).count() == 0


def test_decontamination_of_short_items(spark):
    from plumbline.llm.decontamination import contaminated

    rng = random.Random(8)
    items, docs = [], []
    for i, size in enumerate([8, 9, 10, 12, 15, 19, 20, 23, 29, 30, 31, 39, 40, 55]):
        item = "".join(rng.choice("abcdefghijklmnop") for _ in range(size))
        items.append((i, item))
        for n in range(size // 10 + 2):  # so many substitutions, evenly spread, the last one too many
            text = list(item)
            for k in range(n):
                text[(k + 1) * size // (n + 1)] = "#"
            docs.append((100 * i + n, f"zz {''.join(text)} yy"))
    want = sorted((d, i, edits(x.encode(), t.encode())) for d, t in docs for i, x in items if edits(x.encode(), t.encode()) <= len(x) // 10)
    assert len(want) == sum(len(x) // 10 + 1 for _, x in items)
    out = contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.distance) for r in out.collect()) == want


def test_decontamination_of_very_short_items(spark):
    from plumbline.llm import decontamination as dc

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    items = [(i, rng.choice([" ", "  "]).join(word() for _ in range(rng.randint(1, 4)))) for i in range(60)] + [(90, "Ab"), (91, " "), (92, None), (93, "abababa")]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(40)] + [(50, "ab"), (50, "ab"), (51, None), (None, "x\n AB\t."), (52, "abababa"), (53, "abababab")]
    want = []
    for d, t in docs:
        text = b" " + dc.normal(t or "") + b" "
        for i, x in items:
            a = dc.normal(x or "")
            if a and len(a) < dc.Q and b" " + a + b" " in text:
                at = text.index(b" " + a + b" ")
                want.append((d, i, 0, at, at + len(a)))
    got = dc.contaminated(frame(spark, docs), frame(spark, [(i, x) for i, x in items if len(dc.normal(x or "")) < dc.Q], "item_id long, text string"))
    assert sorted_rows(got, "doc_id", "item_id", "distance", "start", "end") == sorted(want, key=repr) and len(want) > 100
