"""The entry points with and without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q) and 'REC01_ema' in q; assert not [n for n in q if n.startswith('op') or n == 'pipeline']"


@pytest.mark.parametrize("left", ["nothing", "pipeline", "caches"])
def test_entry_without_the_corpus_operators(tmp_path, left):
    """Whatever of them is left behind, the other queries are there."""
    shutil.copytree(ROOT / "barloom", tmp_path / "barloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left != "nothing" and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    if left == "caches":
        (tmp_path / "barloom" / "llm" / "__pycache__").mkdir(parents=True)
    subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, check=True, timeout=120)
