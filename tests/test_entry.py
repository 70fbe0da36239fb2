"""The driver contract without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q); print(sum(n.startswith('op') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("gone", [("gamelode/llm", "tests/llm"), ("gamelode/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_corpus_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    found = subprocess.run([sys.executable, "-c", SAYS], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
    assert found.returncode == 0, found.stderr
    assert found.stdout.strip() == "0"
