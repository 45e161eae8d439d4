"""The driver contract, with and without the training-data folders."""

import subprocess
import sys

import __spark_entry__ as e


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries()) and "line_signatures_topk" in e.queries()


def test_entry(spark):
    assert e.entry(spark).columns == ["signature", "n", "example"]


def test_imports_without_the_training_data_folders(tmp_path):
    """A copy without them still imports, and has the library's own queries."""
    import shutil
    from pathlib import Path

    root = Path(e.__file__).parent
    shutil.copytree(root / "rowsmith", tmp_path / "rowsmith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kv_roundtrip' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
