"""The driver contract holds with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_only_for_known_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_training_data(tmp_path):
    shutil.copytree(ROOT / "scriptorium", tmp_path / "scriptorium", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = (
        "import __spark_entry__ as e; from scriptorium.session import get_session; s = get_session('t', cores=2); q = e.queries()\n"
        "assert len(q) > 100 and e.oracle_sql() and not any(k.startswith('op') for k in q) and 'pipeline' not in q\n"
        "assert q['tx13_shorten'](s, '/root/testdata/sf0.001').count() > 0"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300)
