"""Executors need no installation of the package: everything a task uses travels with it."""

import os
import subprocess
import sys

import pytest
from oracle import DATA

FOLDER = f"{DATA}/sf0.001"
SCRIPT = """
import importlib.util, sys
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("contract", sys.argv[1])
contract = importlib.util.module_from_spec(spec)
spec.loader.exec_module(contract)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("html_blocks", "chunk_hybrid", "sitemap_location", "kb_search", "kb_search_batch", "stream_last_n"):
    assert contract.queries()[name](spark, sys.argv[2]).count() > 0, name
print("shipped")
"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_tasks_do_not_import_the_package(tmp_path):
    contract = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, contract, FOLDER], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "shipped" in done.stdout, done.stderr[-3000:]
