"""The driver's entry points, with and without the corpus subpackage."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "quaver", tmp_path / "quaver", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
assert e.corpus is None and len(e.queries()) > 100
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert e.entry(spark).count() == 5
assert e.queries()["job_states"](spark, "/root/testdata/sf0.001").count() > 0
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
