"""The library without its removable subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in [*q, *o]))"


@pytest.mark.skipif(not (ROOT / "epochsql/llm").is_dir(), reason="removed here")
@pytest.mark.parametrize("pipeline_too", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline_too):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *["corpus_pipeline.py"] * pipeline_too))
    out = subprocess.run([sys.executable, "-c", SAY], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, o, any_left = out.stdout.split()
    assert int(n) >= int(o) > 80 and any_left == "False"
    out = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stdout + out.stderr


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "epochsql").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "llm" not in f.read_text(), f
