import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [("sigspark/llm", "tests/llm"), ("sigspark/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_the_training_data_operators(tmp_path, gone):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path)
    shutil.copytree(REPO / "sigspark", tmp_path / "sigspark")
    for name in gone:
        shutil.rmtree(tmp_path / name, ignore_errors=True)
        (tmp_path / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 40 and set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    names = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert "pipeline" not in names and "search_classic" in names


def test_entry_takes_no_pipeline_of_another_folder(tmp_path):
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    shutil.copytree(REPO / "sigspark", tmp_path / "sigspark")
    env = os.environ | {"PYTHONPATH": str(REPO)}
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and 'op2_lines' in e.queries()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True)
