"""Documents written as lists."""

import glob

from plumbline.sources import readers as R, sinks as S


def test_files_do_not_grow_one_by_one_with_documents(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(S, "DOCS_A_FILE", 50)
    docs = [(i, f'{{"k": {i},\n "v": "a,]b{i}"}}') for i in range(400)]
    path = str(tmp_path / "docs")
    S.write_docs(spark.createDataFrame(docs, "id int, value string"), "id", "value", path)
    assert len(glob.glob(path + "/**/part-*", recursive=True)) <= 8
    got = R.json_doc(spark, path, "k int, v string").collect()
    assert sorted(tuple(r) for r in got) == [(i, f"a,]b{i}") for i in range(400)]
