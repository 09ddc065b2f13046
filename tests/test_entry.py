"""The driver's contract, with and without the subpackage of training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry_runs(spark):
    found = entry.entry(spark)
    assert found.columns and found.count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); print(len(q), any(x.startswith('op') for x in q))"], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) > 100 and said.stdout.split()[1] == "False"
