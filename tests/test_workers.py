"""Tasks must not need this package on the workers' path."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
FOLDER = "/root/testdata/sf0.001"
SCRIPT = """
import sys; sys.path.insert(0, {root!r})
import __spark_entry__ as registry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("recursive_fragments", "passage_vectors", "semantic_search", "semantic_search_in_blocks", "bm25_search", "cleaned_pages", "poverty_correlation_p_values"):
    assert registry.queries()[name](spark, {folder!r}).count() > 0, name
print("finished")
"""


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_queries_with_python_tasks_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=str(ROOT), folder=FOLDER)], cwd=tmp_path, env=env,
        capture_output=True, text=True, timeout=600,
    )
    assert "finished" in done.stdout, done.stderr[-3000:]
