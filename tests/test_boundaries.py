"""Nothing outside the text subpackage imports it, and the entry works without it."""

import ast
import pathlib
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def imported(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            yield node.module
            yield from (f"{node.module}.{a.name}" for a in node.names)


def test_library_does_not_import_text_operators():
    for path in (ROOT / "tidewise").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not [m for m in imported(path) if m.startswith(("tidewise.llm", "corpus_pipeline"))], path


@pytest.mark.parametrize("left", ["nothing", "an empty folder"])
def test_entry_without_text_operators(tmp_path, left):
    shutil.copytree(ROOT / "tidewise", tmp_path / "tidewise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left != "nothing":
        (tmp_path / "tidewise/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*q)"
    names = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin"}, capture_output=True, text=True, check=True).stdout.split()
    assert "cv_seasonal_naive_metrics" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
