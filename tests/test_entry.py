import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) >= 246 and set(o) <= set(q)"
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_flagship_query_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["grp", "run", "reward", "advantage"]
