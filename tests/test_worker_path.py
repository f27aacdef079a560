"""The stream folds run in Python workers: they must not need this package on the workers' path
(a driver may add the repo with sys.path.insert only)."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from fanin.session import build_session
from fanin.plans.catalog import queries
spark = build_session()
for name in ("ttl_dedupe_stream", "breaker_stream"):
    print(name, queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_streams_run_without_package_on_worker_path():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=tempfile.mkdtemp(prefix="fanin-cwd-"), env=env,
                         capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-3000:]
    assert "ttl_dedupe_stream 1000" in out.stdout and "breaker_stream 1000" in out.stdout
