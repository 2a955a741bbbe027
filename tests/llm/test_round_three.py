"""Periodic runs, importance resampling and the URL filter against brute force, on awkward small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.importance import Vocabulary, importance_resample, pieces
from plumbline.llm.periodic_runs import periodic_runs, planted, runs_of, symbols
from plumbline.llm.q_url_filter import RULES
from plumbline.llm.url_filter import url_filter
from tests.llm.test_operators import awkward, frame, nothing, words_of  # noqa: F401  (fixtures)

# ---- periodic runs


def plain_runs(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(q % p == 0 and s <= i and j + q <= e for s, e, p in found):
                found.append((i, j + q, q))
            i = j
    return sorted(found)


def plain_row(doc_id, words):
    found = plain_runs(words)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    told = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    longest = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return doc_id, len(found), *longest, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def periodic_words(rng):
    n, letters = rng.randrange(90), rng.choice([1, 2, 2, 3, 20])
    w = [f"x{rng.randrange(letters)}" for _ in range(n)]
    unit = w[: rng.randrange(1, 8)]
    kind = rng.randrange(3)
    if kind == 1 and n:
        w = w[: n // 3] + unit * rng.randrange(3, 9) + unit[: rng.randrange(len(unit) + 1)] + w[n // 2 :]
    if kind == 2 and n:
        w = (unit * 5 + ["y"]) * rng.randrange(1, 7) + w[:5]
    return w


def test_runs_by_grammar_are_all_runs():
    rng = random.Random(11)
    for _ in range(400):
        docs = [periodic_words(rng) for _ in range(rng.randrange(1, 5))]
        numbers, want, at = {}, [], 0
        ids = np.array([numbers.setdefault(w, len(numbers)) for d in docs for w in d], np.int64)
        for d in docs:
            want += [(s + at, e + at, q) for s, e, q in plain_runs(d)]
            at += len(d)
        assert runs_of(ids, np.repeat(np.arange(len(docs)), [len(d) for d in docs])) == sorted(want)


def test_grammar_symbols_expand_alike():
    rng = random.Random(3)
    ids = np.array([rng.randrange(3) for _ in range(600)], np.int64)
    begin, boundary, end, name = symbols(ids, np.repeat([0, 1], 300))
    seen = {}
    for b, m, e, k in zip(begin, boundary, end, name):
        words = tuple(ids[b:e])
        assert b < m < e and (e <= 300 or b >= 300)
        assert seen.setdefault(k, (words, m - b)) == (words, m - b)
    assert len(seen) < len(name)  # symbols recur: the text is compressed
    # both documents end in one symbol that spans them
    assert {(0, 300), (300, 600)} <= set(zip(begin.tolist(), end.tolist()))


def test_runs_of_long_texts_stay_fast():
    for w in ([0] * 100_000, ([0, 0, 0, 1] * 500 + [2]) * 40, list(range(100_000)), [x % 7 for x in range(100_000)]):
        ids = np.array(w, np.int64)
        found = runs_of(ids, np.zeros(len(ids), np.int64))
        assert all((ids[s : e - q] == ids[s + q : e]).all() for s, e, q in found)
    assert found == [(0, 100_000, 7)]


def test_op11_rows(spark, awkward, nothing):
    rng = random.Random(7)
    rows = [(i, " ".join(periodic_words(rng))) for i in range(60)] + [(None, "a b " * 9), (None, None), (3, "a\x85b " * 8), (5, "a \n" * 40)]
    df = frame(spark, rows).unionByName(awkward.filter(F.length("text") < 20_000))
    plain = [(r.doc_id, words_of(r.text)) for r in df.select("doc_id", "text").collect()]
    for change in (None, planted):
        want = sorted((plain_row(d, change(w, d) if change else w) for d, w in plain), key=repr)
        got = sorted((tuple(r) for r in periodic_runs(df, change).collect()), key=repr)
        assert got == want
    assert periodic_runs(nothing).count() == 0
    text = periodic_runs(frame(spark, [(1, "go a b a b a b a b a b on")]), with_text=True).first()
    assert (text.start, text.length, text.period, text.collapsed) == (1, 10, 2, "go a b on")


def test_planted_words():
    for doc_id in range(300):
        words = [f"w{i}" for i in range(50)]
        h = zlib.crc32(str(doc_id).encode())
        out = planted(words, doc_id)
        if h % 10:
            assert out == words
        else:
            a = h // 10 % 50
            p = 1 + (50 - a) // (3 + h // 10 % 8)
            assert out[:a] == words[:a] and all(out[i] == words[a + (i - a) % p] for i in range(a, 50))
    assert planted([], 7) == []


# ---- importance resampling

TOKEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    ws = TOKEN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [f.encode() for f in [*ws, *map(" ".join, zip(ws, ws[1:]))]], len(ws)


def plain_resample(docs, target, share, least, seed, buckets):
    total = lambda texts: Counter(zlib.crc32(f) % buckets for t in texts for f in features(t)[0])
    s, t = total(x for _, x in docs), total(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for doc_id, text in docs:
        found, n = features(text)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    place = {id(r): i for i, r in enumerate(able[: share * len(able) // 100], 1)}
    return sorted((tuple(r[:4]) + (place.get(id(r)),) for r in rows), key=repr)


def test_op12_rows(spark, awkward, nothing):
    rng = random.Random(2)
    extra = [(100 + i, " ".join(rng.choice(["alpha", "Beta", "gamma9", "é", "of"]) for _ in range(rng.randrange(15, 40)))) for i in range(60)]
    df = awkward.unionByName(frame(spark, extra + [(None, "alpha beta " * 30)] * 5 + [(7, "one two three " * 10)] * 4))
    target = frame(spark, [(1, "alpha BETA gamma9"), (2, None), (3, "of of of é"), (4, "")]).withColumnRenamed("doc_id", "item_id")
    docs = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    aim = [r.text for r in target.select("text").collect()]
    for share, buckets in ((25, 10_000), (100, 97)):
        got = sorted((tuple(r) for r in importance_resample(df, target, share=share, buckets=buckets).collect()), key=repr)
        assert got == plain_resample(docs, aim, share, 20, 7, buckets)
    drawn = [r["rank"] for r in importance_resample(df, target).collect() if r["rank"] is not None]
    assert sorted(drawn) == list(range(1, len(drawn) + 1))
    assert importance_resample(nothing, target).count() == 0
    empty = target.filter("false")
    assert sorted((tuple(r) for r in importance_resample(df, empty).collect()), key=repr) == plain_resample(docs, [], 25, 20, 7, 10_000)


def test_head_and_tail_give_the_same_buckets():
    rng = random.Random(9)
    text = " ".join(f"w{rng.randrange(60)}" for _ in range(3000)) + " é日本 Ü0"
    words = next(pieces(text))[0]
    tables = [([], []), ([b"w1", b"w2", b"w3"], [b"w1 w2", b"w3 w1", b"w9 w1"]), (sorted(set(words)), [b" ".join(p) for p in zip(words, words[1:])])]
    found = [Vocabulary(head, pairs, 1009).of([(0, words, False), (1, words[:5], True)]) for head, pairs in tables]
    for one, two, _ in found:
        assert one[: len(words)].tolist() == [zlib.crc32(w) % 1009 for w in words]
        assert two[: len(words)].tolist() == [zlib.crc32(b" ".join(p)) % 1009 for p in zip(words, words[1:])] + [-1]
        assert one[len(words)] == -1


def test_long_texts_are_cut_without_losing_pairs(monkeypatch):
    from plumbline.llm import importance

    monkeypatch.setattr(importance, "GROUP", 50)
    text = " ".join(f"word{i}" for i in range(200)) + "   " + "z" * 300 + "  end "
    cut = list(importance.pieces(text))
    assert len(cut) > 5 and [w for ws, led in cut for w in ws[led:]] == importance.words_of(text)
    assert [p for ws, _ in cut for p in zip(ws, ws[1:])] == list(zip(importance.words_of(text), importance.words_of(text)[1:]))


# ---- URL filter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = re.split("[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def plain_rule(host, path):
    fits = [(len(r), r, says) for r, says in RULES for name, at in [(r[: r.index("/")], r[r.index("/") :])] if (host == name or host.endswith("." + name)) and path.startswith(at)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "http://a.example.org/es/1", "HTTP://A.Example.ORG/en/12?x=/fr/", "https://example.org/en/2", "http://example.org", "http://notorg/", "http://org/x", "http://xorg/a",
    "ftp://b.com/fr/a", "http://b.com/de/a", "http://b.com/DE/a", "http://b.com?/fr/", "http://b.com#/fr/", None, "", "no scheme", "a://", "http://u@c.co.uk:80/x://y", "http://10.0.0.1/x", "http://É.com/fr/", "x\ny://d.net/\n?z",
]


def test_op13_parts_and_rules(spark, nothing):
    pages = spark.createDataFrame([(i % 17, u) for i, u in enumerate(URLS * 2)], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("bad", F.lit(1))
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = sorted((tuple(r) for r in url_filter(pages, none, RULES).select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)
    want = []
    for i, u in enumerate(URLS * 2):
        host, path = parts(u)
        rule, says = plain_rule(host, path)
        want.append((i % 17, host, path, rule, says or "allow"))
    assert got == sorted(want, key=repr)
    assert url_filter(pages.filter("false"), none, RULES).count() == 0


def test_op13_reputation(spark):
    """Bad hosts go, a bad domain takes its unseen hosts along, a host with one bad page does not go."""
    rows, bad, k = [], [], 0
    for host, n, b in [("farm.spam.net", 60, 55), ("shop.spam.net", 40, 37), ("mall.spam.net", 50, 44), ("new.spam.net", 3, None), ("news.good.net", 80, 2), ("blog.good.net", 60, 1), ("one.good.net", 1, 1), ("x.fine.com", 200, 8), ("y.fine.com", 100, 2)]:
        for i in range(n):
            rows.append((k, f"http://{host}/{i}"))
            if b is not None:
                bad.append((k, i < b))
            k += 1
    told = spark.createDataFrame(bad + [(None, True), (3, None), (0, False)], "page_id long, bad boolean")
    out = {r.host: r for r in url_filter(spark.createDataFrame(rows, "page_id long, url string"), told, []).dropDuplicates(["host"]).collect()}
    blocked = {h for h, r in out.items() if r.verdict == "block"}
    assert {"farm.spam.net", "shop.spam.net", "mall.spam.net", "new.spam.net"} == blocked
    assert (out["one.good.net"].host_labelled, out["one.good.net"].host_bad) == (1, 1)
    assert out["farm.spam.net"].host_bound_milli > out["new.spam.net"].host_bound_milli > out["one.good.net"].host_bound_milli
    # everything from one host: nothing to compare it with, its own rate decides
    alone = url_filter(spark.createDataFrame([(i, "http://h.io/") for i in range(50)], "page_id long, url string"), spark.createDataFrame([(i, True) for i in range(50)], "page_id long, bad boolean"), [])
    assert {r.verdict for r in alone.collect()} == {"block"}


def test_queries_equal_their_sql(spark):
    import os

    import plumbline.llm.queries as registry
    from tests.oracle import compare, connect

    folder = os.environ.get("PLUMBLINE_TEST_DIR", "/root/testdata/sf0.001")
    registry.load()
    for name in ("op11_periodic_runs", "op12_importance_resample", "op13_url_filter"):
        assert compare(spark, connect(folder), registry.QUERIES[name], registry.ORACLE[name], folder)[1] is None, name


# ---- near-dedup and toxicity: crowds under one id, long obfuscated texts


def test_near_dedup_of_rows_that_share_an_id_or_have_none(spark):
    """Thousands of different texts without an id, and under id 0, are apart; copies among them are found."""
    from plumbline.llm.near_dedup import near_dedup

    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(12))
    rows = [(None, text()) for _ in range(6000)] + [(0, text()) for _ in range(6000)]
    base = " ".join(f"b{i}" for i in range(60))
    near = base.replace("b30", "other")
    rows += [(None, base), (9, near), (12, base), (12, base)] + [(0, "same text of many rows again and again")] * 3000
    out = near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).groupBy("doc_id", "component_id", "kept").count().collect()
    got = {(r.doc_id, r.component_id, r.kept): r["count"] for r in out}
    assert got == {(None, None, False): 6000, (None, 9, False): 1, (0, 0, True): 9000, (9, 9, True): 1, (12, 9, False): 2}


def small_model():
    from plumbline.llm.toxicity import SIZE, language_model

    rng = np.random.default_rng(1)
    return language_model(rng.integers(0, 40, (SIZE, SIZE, SIZE)).astype(float))


def every_reading(text, model):
    from plumbline.llm.toxicity import CODES, OTHER, lattice

    found = {"": [((0, 0), 0.0)]}
    for options in lattice(text):
        grown = {}
        for t, ways in found.items():
            for (x0, y0), score in ways:
                for piece, cost in options:
                    x, y, s = x0, y0, score - cost
                    for c in piece:
                        z = 0 if c == " " else CODES.get(c, OTHER if c.isalpha() else 0)
                        s += float(model[x, y, z])
                        x, y = y, z
                    grown.setdefault(t + piece, []).append(((x, y), s))
        found = {t: [max(w, key=lambda v: v[1]) for w in [[v for v in ways if v[0] == st] for st in {v[0] for v in ways}]] for t, ways in grown.items()}
    return {t: max(s + float(model[x, y, 0]) for (x, y), s in ways) for t, ways in found.items()}


def test_decode_is_the_best_of_all_readings():
    from plumbline.llm.toxicity import decode

    model, rng = small_model(), random.Random(8)
    for _ in range(120):
        text = "".join(rng.choice("ab1 5*-$ll0.'!") for _ in range(rng.randrange(1, 8)))
        scores = every_reading(text, model)
        best = sorted(scores.values(), reverse=True)[:3]
        got = decode(text, model)
        assert len(got) == len(set(got)) and np.allclose([scores[t] for t in got], best)


def test_long_spaced_texts_take_linear_time():
    import time

    from plumbline.llm.toxicity import SPACED, decode

    model = small_model()
    text = " ".join(random.Random(2).choice("0123456789") for _ in range(30_000))
    start = time.time()
    assert SPACED.search(text)[0] == text and len(decode(text, model)) == 3
    for awkward in ("_" * 5000 + "(", "a_" * 5000 + "b(", "a" + "-_" * 5000 + "c("):
        assert SPACED.search(awkward) is None
    assert time.time() - start < 30
