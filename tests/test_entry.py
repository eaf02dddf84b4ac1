"""The entry module with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and "missing" in out.columns


def test_names():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and all(callable(f) for f in q.values())


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_without_the_operators(tmp_path, gone):
    """With the two folders gone, and with the pipeline gone as well."""
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(*gone, ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not [k for k in q if k.startswith('op')] and set(e.oracle_sql()) <= set(q); print(len(q))"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert run.returncode == 0, run.stderr


def test_errors_of_the_operators_are_not_hidden(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    package = tmp_path / "repo" / "quayside"
    if not (package / "llm").exists():
        pytest.skip("the operators are taken out")
    (package / "llm" / "queries.py").write_text("import no_such_module\n")
    run = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert run.returncode != 0 and "no_such_module" in run.stderr
