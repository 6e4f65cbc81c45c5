"""The library stands without the subpackage for text collections."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("left_out", [("gatherline/llm", "corpus_pipeline.py"), ("gatherline/llm",), ("corpus_pipeline.py",)])
def test_entry_imports_without_text_operators(tmp_path, left_out):
    gone = {Path(p).name for p in left_out}
    for name in ("gatherline", "__spark_entry__.py", "corpus_pipeline.py"):
        if name in left_out:
            continue
        src = ROOT / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=lambda d, names: {n for n in names if n == "__pycache__" or (n in gone and n == "llm")})
        elif src.exists():
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op1') for n in q)); assert len(e.oracle_sql()) > 150"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert "True" not in out.stdout.split()[1]


def test_nothing_else_imports_the_text_operators():
    for path in (ROOT / "gatherline").rglob("*.py"):
        if "llm" not in path.parts:
            assert "gatherline.llm" not in path.read_text(), path
