"""Repair of broken JSON."""

import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as X

CASES = [
    ('{"a": 1}', {"a": 1}),
    ("{'name': 'P', 'ok': True, 'x': None, 'n': '5', 'sub': {'k': 5, 'cut': 'unfin", {"name": "P", "ok": True, "x": None, "n": 5}),
    ('{"a": "abc"def"}', {"a": "abcdef"}),
    ('{\\"a\\": \\"x\\"}', {"a": "x"}),
    ('{"a": []", "b": "1e5", "c": "null", "d": [\'1E+2\', "7"]}', {"a": [], "b": 1e5, "c": None, "d": [100.0, "7"]}),
    ('{"a": "say \\"hi\\" now", "b": 2,}', {"a": 'say "hi" now', "b": 2}),
    ("{'it': 'it's fine', 'l': array([1, 2]), 'm': array(3)}", {"it": "it's fine", "l": [], "m": []}),
    ('{"none": "None of True", "b": False}', {"none": "None of True", "b": False}),
    ('{"a": 1, "s": {"k": 5, "j": 6, "cut": "unf', {"a": 1, "s": {"k": 5}}),
    ('{"a": {"x": 1}, "b": {"y": 2}', {"a": {"x": 1}, "b": {"y": 2}}),
    ('[{"a": 1}, {"b": 2', [{"a": 1}, {"b": 2}]),
    ('no braces "k": "v", "n": 3, "n": 4, "t": True', {"k": "v", "n": 3, "t": True}),
    ('{"a": "x", "b": [1, 2}', {"a": "x"}),
    ('text {"a": None} tail', {"a": None}),
    ('{"a": "new\nline", "b": "x\\y"}', {"a": "new line", "b": "x\\y"}),
    ("", {}),
]


@pytest.mark.parametrize("text, want", CASES)
def test_repaired(text, want):
    assert json.loads(X.repaired_json(text)) == want


def test_column_and_helper_agree(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(-1, None), (-2, '{"a": 1} x'), (-3, "7")], "id int, t string")
    got = {r["id"]: r["j"] for r in df.select("id", X.repair_json(F.col("t")).alias("j")).collect()}
    assert got.pop(-1) is None and json.loads(got.pop(-2)) == {"a": 1} and got.pop(-3) == "7"
    assert [json.loads(got[i]) for i in range(len(CASES))] == [want for _, want in CASES]


def test_whatever_is_cut_or_garbled_parses():
    rnd = random.Random(3)
    whole = json.dumps({"a": [1, {"b": "x, y"}], "c": {"d": None, "e": "it's"}, "f": 1.5})
    for _ in range(3000):
        text = whole[: rnd.randint(0, len(whole))]
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(text))
            text = text[:at] + rnd.choice("{}[]\"',:\\ x1") + text[at + rnd.randint(0, 1) :]
        json.loads(X.repaired_json(text))


def test_long_broken_texts_end():
    for text in ("{" * 200_000, "[" * 100_000 + "1", "'" * 300_000, '{"a": "' * 50_000, '{"a":1,' * 60_000, '{"k": ' + "\\" * 300_000, "array(" * 50_000):
        assert isinstance(X.repaired_json(text), str)
