"""The repository works without its corpus subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_corpus_subpackage(tmp_path):
    for p in ("trilayer", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "trilayer" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql())); assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_nothing_else_imports_the_corpus_subpackage():
    for p in (ROOT / "trilayer").rglob("*.py"):
        if "llm" not in p.parts:
            assert "trilayer.llm" not in p.read_text(), p
