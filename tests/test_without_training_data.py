"""The rest of the library without the training-data operators and their pipeline."""

from __future__ import annotations

import shutil
import subprocess
import sys

import pytest

from conftest import ROOT

PROBE = "import __spark_entry__ as e; n = e.queries(); assert set(e.oracle_sql()) <= set(n); print(sum(k.startswith('op') or k == 'pipeline' for k in n), len(n))"


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_rest_imports_without_them(tmp_path, also):
    gone = shutil.ignore_patterns("llm", ".git", "__pycache__", *also)
    shutil.copytree(ROOT, tmp_path / "copy", ignore=gone)
    found = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
    training, registered = map(int, found.stdout.split())
    assert training == 0 and registered > 90
