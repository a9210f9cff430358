"""The entry module without the optional parts of the repository."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def listed(folder: Path) -> list[str]:
    code = "import __spark_entry__ as e; print(*e.queries(), *e.oracle_sql())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


@pytest.mark.parametrize("gone", [["lodestone/llm", "tests/llm"], ["lodestone/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_optional_parts(tmp_path, gone):
    whole = tmp_path / "repo"
    shutil.copytree(ROOT, whole, ignore=shutil.ignore_patterns(".git", "__pycache__", *(g.rsplit("/", 1)[-1] for g in gone if g.endswith(".py"))))
    for g in gone:
        shutil.rmtree(whole / g, ignore_errors=True)
    assert not (whole / "lodestone/llm").exists()
    names = listed(whole)
    assert "bm25_topk" in names and "pipeline" not in names and not [n for n in names if n.startswith("op") and n[2].isdigit()]
