"""The driver's entry points, with and without the training-data folder."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.limit(1).count() == 1 and "vis_re" in df.columns


def test_imports_without_the_training_data_folder(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "skyfringe", tmp_path / "skyfringe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'a01_coalesce' in q and e.oracle_sql(); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
