"""Queries as the first of a session, whose first columns have the smallest expression numbers."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "4").getOrCreate()
print("rows", __spark_entry__.queries()[sys.argv[1]](spark, __spark_entry__.SMOKE_DIR).count())
"""


@pytest.mark.parametrize("name", ["dump_open_files", "detect_beta", "detect_fileless", "detect_java_batch", "detect_forfiles_wmic", "lolbin_scores", "classify_lines", "summary_counters"])
def test_query_comes_first(name, tmp_path):
    got = subprocess.run([sys.executable, "-c", RUN, name], cwd=ROOT, env=os.environ | {"TMPDIR": str(tmp_path)}, capture_output=True, text=True)
    assert got.returncode == 0, got.stderr[-3000:]
    assert int(got.stdout.split()[-1]) > 0
