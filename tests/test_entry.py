"""The registered queries: schemas agree with their SQL, and removing the corpus subpackage leaves the rest whole."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_rest_stands_alone(tmp_path, gone):
    """Without the two llm folders, and without the pipeline as well: the rest imports and registers its queries."""
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); assert not any(n == 'pipeline' for n in e.oracle_sql())"
    env = os.environ | {"PYTHONPATH": str(tmp_path / "r")}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=env)
