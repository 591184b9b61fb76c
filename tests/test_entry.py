"""The entry module can be imported before there is a session."""

import subprocess
import sys
from pathlib import Path


def test_queries_and_twins_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and all(isinstance(x, str) for x in s.values())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)
