"""The registry, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_subpackage(tmp_path):
    for name in ("skein", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'pipeline' not in q and not any(n.startswith('op') for n in q); print(len(e.oracle_sql()))"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
