"""Without the training-data part the rest of the repository works."""

import shutil
import subprocess
import sys

import pytest

from conftest import ROOT

ASK = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
assert len(e.queries()) > 50 and set(e.oracle_sql()) <= set(e.queries())
assert not any(n == "pipeline" or n.startswith("op") for n in e.queries()), "training data"
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.queries()["gene_name_reset"](spark, {data!r}).count() > 0
import bench
print("works")
"""


@pytest.mark.parametrize("gone", [("cytolith/llm", "tests/llm"), ("cytolith/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_works_without_it(gone, tmp_path, sf_dir):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md"))
    for name in gone:
        path = tmp_path / "r" / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", ASK.format(data=sf_dir)], cwd=tmp_path / "r", capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("works"), done.stderr[-3000:]
