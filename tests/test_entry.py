"""The entry point works without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
PROBE = """
import __spark_entry__ as e
from postlens.session import local_session
names = set(e.queries())
assert "clean_postings" in names and set(e.oracle_sql()) <= names
assert not any(n == "pipeline" or n.startswith("op") and n[2:3].isdigit() for n in names), names
spark = local_session(2, 2, "1g")
assert e.queries()["headline_numbers"](spark, "/root/testdata/sf0.001").count() == 1
"""


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables not present")
@pytest.mark.parametrize("with_pipeline", [True, False])
def test_without_operators(tmp_path, with_pipeline):
    shutil.copytree(REPO / "postlens", tmp_path / "postlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    if with_pipeline:
        shutil.copy(REPO / "corpus_pipeline.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path, capture_output=True, text=True,
                          timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
