"""Every pipeline stage against brute force on its own input, then the whole run."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_operators import brute_components, edits, sentence

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, chunk string, cleaned string, n_removed string, predicted string, kept string, item_id string"


def corpus():
    rng = random.Random(11)
    rows, labels = [], []
    base, shared = sentence(rng, 100), sentence(rng, 30)
    item = sentence(rng, 14)
    for i in range(60):
        toxic = i % 4 == 0
        text = sentence(rng, 40)
        if toxic:
            text = text.replace(" ", rng.choice([" vermin ", " v3rm1n "]), 2)
        rows.append((i, text))
        labels.append((i, int(toxic)))
    rows += [(100, base), (101, base + " more"), (102, base.upper()), (101, base + " more")]
    rows += [(200, f"é{shared}é"), (201, f"{sentence(rng, 20)} {shared} end"), (202, shared), (203, None), (204, ""), (None, shared), (None, None)]
    rows += [(300, f"{sentence(rng, 20)} {item.upper()} {sentence(rng, 20)}"), (301, sentence(rng, 50))]
    return rows, labels, [(1, item), (2, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels, bench = corpus()
    full = [(d, t, "en", "s", None if t is None else len(t), "c", "x", "x", "x", "x", "x") for d, t in rows]
    spark.createDataFrame(full, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=repr)


def test_toxic_documents_go(spark, docs, folder):
    out = P.without_toxic(spark, docs, folder)
    toxic = {d for d, y in corpus()[1] if y}
    assert out.columns == docs.columns
    assert ids(out) == sorted((d for d, _ in corpus()[0] if d not in toxic), key=repr)


def test_one_of_each_near_copy_stays(spark, docs, folder):
    rows = corpus()[0]
    want = {r[0] for r in brute_components(rows, 5, 80) if r[3]}
    out = P.without_near_copies(spark, docs, folder)
    assert out.columns == docs.columns and ids(out) == sorted([*want, None, None], key=repr)


def test_repeated_strings_go(spark, docs, folder):
    rows = corpus()[0]
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            key = float("inf") if d is None else d
            first[b[p : p + 50]] = min(key, first.get(b[p : p + 50], key))
    want = []
    for d, t in rows:
        b, out = (t or "").encode(), ""
        mask = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < (float("inf") if d is None else d):
                mask[p : p + 50] = True
        at = 0
        for c in t or "":
            n = len(c.encode())
            out += "" if mask[at : at + n].all() else c
            at += n
        want.append((d, None if t is None else out, None if t is None else len(out)))
    out = P.without_repeats(spark, docs, folder)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_benchmark_documents_go(spark, docs, folder):
    rows, _, bench = corpus()
    item = bench[0][1].lower().encode()
    want = [d for d, t in rows if d is None or edits(item, " ".join((t or "").lower().split()).encode()) > len(item) // 10]
    out = P.without_benchmark(spark, docs, folder)
    assert out.columns == docs.columns and ids(out) == sorted(want, key=repr)


def test_packing_holds_every_token(spark, docs, folder):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = sum(len(model.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in corpus()[0])
    assert P.packed(spark, docs, folder).agg(F.sum("length")).first()[0] == n


def test_run(spark, folder, tmp_path):
    rows, labels, _ = corpus()
    gone = {d for d, y in labels if y} | {101, 102, 202, 300}
    assert set(ids(P.run(spark, folder).select("doc_id").distinct())) == {d for d, _ in rows} - gone
    assert [name for name, _ in P.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_rows_that_share_an_id_are_judged_one_by_one(spark, folder, tmp_path):
    rng = random.Random(5)
    texts = [sentence(rng, 40) for _ in range(12)]
    item = sentence(rng, 14)
    toxic = " vermin ".join(sentence(rng, 8) for _ in range(5))
    bad = [(0, toxic), (None, toxic)]
    held = [(0, f"{sentence(rng, 20)} {item} end"), (None, f"{item} {sentence(rng, 20)}")]
    # the first text is the copy of a smaller id's; the others of id 0 are alone, as are rows without words
    rows = [(-1, texts[0]), (0, texts[0] + " more"), *[(0, t) for t in texts[1:8]], (0, texts[7]), (0, texts[6] + " more"), (0, None), (0, ""), (0, ""), (None, texts[9])]
    frame = lambda given: spark.createDataFrame([(*r, f"e{i}") for i, r in enumerate(given)], "doc_id long, text string, extra string")

    out = P.without_near_copies(spark, frame(rows), folder)
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    either = [t for t in (texts[6], texts[6] + " more") if (0, t) in left]
    assert out.columns == ["doc_id", "text", "extra"] and len(either) == 1
    want = [(-1, texts[0]), *[(0, t) for t in [*texts[1:6], texts[7], *either]], (0, None), (0, ""), (0, ""), (None, texts[9])]
    assert left == sorted(want, key=repr)

    plain = [(0, t) for t in texts] + [(None, texts[0])]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = P.without_benchmark(spark, frame(plain + held), str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(plain, key=repr)

    learn = [(1000 + i, (" vermin " if i % 2 else " ").join(sentence(rng, 8) for _ in range(5))) for i in range(120)]
    spark.createDataFrame([(d, d % 2) for d, _ in learn], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = P.without_toxic(spark, frame(plain + bad + learn), str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in got if r.doc_id in (0, None)), key=repr) == sorted(plain, key=repr)
