"""The entry file with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LOAD = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len([n for n in q if not n.startswith('op') and n != 'pipeline']), len(q))"


def loaded(folder):
    out = subprocess.run([sys.executable, "-c", LOAD], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    return tuple(map(int, out.stdout.split()))


def copy(folder, *without):
    skip = lambda at, names: [n for n in names if n in ("__pycache__", ".git") or os.path.relpath(os.path.join(at, n), ROOT) in without]
    shutil.copytree(ROOT, folder, ignore=skip)
    return folder


def test_rest_loads_without_training_data(tmp_path):
    rest, total = loaded(copy(tmp_path / "bare", os.path.join("plumbline", "llm"), os.path.join("tests", "llm"), "corpus_pipeline.py"))
    assert rest == total >= 238


def test_real_import_errors_are_not_hidden(tmp_path):
    where = copy(tmp_path / "broken", os.path.join("plumbline", "llm"))
    (where / "plumbline" / "llm").mkdir()
    (where / "plumbline" / "llm" / "queries.py").write_text("import no_such_module_anywhere\n")
    out = subprocess.run([sys.executable, "-c", LOAD], cwd=where, env=os.environ | {"PYTHONPATH": str(where)}, capture_output=True, text=True)
    assert out.returncode and "no_such_module_anywhere" in out.stderr
