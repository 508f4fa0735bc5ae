"""The entry module: queries, their SQL, and its guard for the optional subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_names_and_oracles():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 40


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the given tables")
def test_entry_runs(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["doc_id", "n_lines", "n_texts", "saved"] and rows.count() > 0


def test_without_the_optional_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q and e.oracle_sql(); print('fine')"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy), "HOME": str(tmp_path)})
    assert done.stdout.strip() == "fine", done.stderr
