from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_rest_stands_without_text_preparation(tmp_path):
    """The entry file and the engine import where tallygrid/llm and corpus_pipeline.py are gone."""
    shutil.copytree(ROOT / "tallygrid", tmp_path / "tallygrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(k.startswith('op1') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_engine_imports_nothing_from_text_preparation():
    for path in (ROOT / "tallygrid").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "tallygrid").parts:
            assert ".llm" not in path.read_text(encoding="utf-8"), path


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
