"""The driver's contract: importable without a session, every query with a callable, every SQL with its query."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_needs_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert all(map(callable, q.values())) and set(o) <= set(q); print(len(q))"
    found = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr[-2000:]
    assert int(found.stdout.split()[-1]) > 150
