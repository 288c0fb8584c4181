import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
SAY = "import __spark_entry__ as e; print(sorted(e.queries())); print(sorted(e.oracle_sql()))"


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_entry_works_without_the_corpus_operators(tmp_path, also):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache"))
    for name in also:
        (tmp_path / "copy" / name).unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert "range_3d" in said.stdout and "op1_" not in said.stdout and "pipeline" not in said.stdout
