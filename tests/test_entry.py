"""The driver's entry points, with the corpus operators and without them."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from motifold.plans.registry import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; print('\\nFOUND', len(e.queries()), len(e.oracle_sql()))"


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_the_corpus_operators(tmp_path, pipeline):
    shutil.copytree(ROOT / "motifold", tmp_path / "motifold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline:  # left behind, or never there
        (tmp_path / "corpus_pipeline.py").write_text("from motifold.llm import queries\n")
        (tmp_path / "motifold" / "llm" / "__pycache__").mkdir(parents=True)
    said = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert said.stdout.split()[-2:] == [str(len(QUERIES)), str(len(ORACLES))], said.stderr
