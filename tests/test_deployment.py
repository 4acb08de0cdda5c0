"""The registered queries from another folder, and what the entry keeps between calls."""

from __future__ import annotations

import os
import subprocess
import sys

import __spark_entry__ as entry
from conftest import ROOT

SCRIPT = """
import sys
from importlib.util import module_from_spec, spec_from_file_location
spec = spec_from_file_location("__spark_entry__", sys.argv[1])
entry = module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config(
    "spark.checkpoint.dir", sys.argv[3] + "/c").config("spark.sql.warehouse.dir", sys.argv[3] + "/w").getOrCreate()
print("ROWS", len(entry.queries()["s04_test_report"](spark, sys.argv[2]).collect()))
"""


def test_queries_run_in_workers_that_do_not_see_the_repository(sf_dir, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run(
        [sys.executable, "-c", SCRIPT, os.path.join(ROOT, "__spark_entry__.py"), sf_dir, str(tmp_path)], cwd=tmp_path, env=env,
        capture_output=True, text=True, timeout=300)
    assert "ROWS 9" in out.stdout, out.stderr[-2000:]


def test_one_bundle_is_kept(spark, sf_dir, tmp_path):
    key = entry.queries()["m01_split"]
    os.symlink(sf_dir, tmp_path / "again")
    for folder in (sf_dir, str(tmp_path / "again")):
        assert key(spark, folder).count() > 0 and len(entry.BUNDLES) == 1
    entry.BUNDLES.clear()
