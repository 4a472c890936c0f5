"""The entry works with and without the corpus operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [["unitloom/llm"], ["unitloom/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"], ["corpus_pipeline.py", "tests/llm", "unitloom/llm"]])
def test_entry_imports_when_parts_are_deleted(tmp_path, gone):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "unitloom"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q), set(s) - set(q); print('table_summary' in q, 'pipeline' in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[-2:] == ["True", "False"]
