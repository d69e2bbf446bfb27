"""The entry module without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_entry_without_llm(tmp_path, also):
    for name in ("comuna", "__spark_entry__.py", "corpus_pipeline.py"):
        if name in also or not (ROOT / name).exists():
            continue
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        copy(ROOT / name, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if copy is shutil.copytree else {}))
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); print(len(q), sorted(k for k in q if k.startswith('op') or k == 'pipeline'), set(o) <= set(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert done.stdout.split(" ", 1)[1].strip() == "[] True"
