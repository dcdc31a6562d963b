"""The driver's entry points, and the independence of the rest from the llm folders."""

import ast
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_a_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=ROOT, check=True)


def test_imports_without_llm(tmp_path):
    import shutil

    shutil.copytree(ROOT / "strandline", tmp_path / "strandline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op1_') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


@pytest.mark.parametrize("path", sorted(p for p in (ROOT / "strandline").rglob("*.py") if "llm" not in p.parts), ids=str)
def test_nothing_else_imports_llm(path):
    for node in ast.walk(ast.parse(path.read_text())):
        names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
        assert not any("llm" in n for n in names)
