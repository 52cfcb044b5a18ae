"""Queries run from any folder: Python on the executors, and beside the driver, finds the package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
for name in ("sync_stream", "recorded_stream"):
    print(name, entry.queries()[name](spark, {sf!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_streams_run_from_another_folder(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN.format(root=root, sf=SF)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "sync_stream 6" in done.stdout and "recorded_stream 3" in done.stdout, done.stderr[-3000:]
