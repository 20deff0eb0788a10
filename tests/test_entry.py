"""The entry module works with and without the text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), len(e.oracle_sql()))"


@pytest.mark.parametrize("gone", [["portmesh/llm"], ["portmesh/llm", "corpus_pipeline.py"]])
def test_without_text_operators(tmp_path, gone):
    names = [n for n in ("portmesh", "__spark_entry__.py", "corpus_pipeline.py") if n not in gone and (ROOT / n).exists()]
    skip = shutil.ignore_patterns("llm", "__pycache__")
    for name in names:
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=skip)
        else:
            shutil.copy(ROOT / name, tmp_path / name)
    found = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(found[0]) > 140 and found[1] == "0" and int(found[2]) > 130
