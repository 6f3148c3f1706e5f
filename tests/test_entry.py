"""The library without its part for training data."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT


def test_the_rest_stands_alone(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse", ".pytest_cache"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    for pipeline in (True, False):
        if not pipeline:
            (copy / "corpus_pipeline.py").unlink()
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
