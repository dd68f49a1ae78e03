"""The entry module without the subpackage for training data."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), set(s) <= set(q))"


def names(folder):
    env = {**os.environ, "PYTHONPATH": str(folder)}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=folder, env=env, capture_output=True, text=True, timeout=300, check=True)
    return out.stdout.split()


def test_without_training_data(tmp_path):
    """With its folders deleted, with or without the pipeline's file, all other queries are there."""
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "spark-warehouse"))
    before = names(tmp_path / "r") if (tmp_path / "r" / "strandlake" / "llm").exists() else None
    shutil.rmtree(tmp_path / "r" / "strandlake" / "llm", ignore_errors=True)
    shutil.rmtree(tmp_path / "r" / "tests" / "llm", ignore_errors=True)
    left = names(tmp_path / "r")
    assert left[1:] == ["0", "True"] and int(left[0]) >= 50
    if before is not None:
        assert int(before[0]) - int(before[1]) == int(left[0])
    (tmp_path / "r" / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names(tmp_path / "r") == left
