"""Executors that have no copy of the package: functions and values must carry what they need."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
spark.sparkContext.setLogLevel("OFF")

def found(batches):
    import importlib.util, pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("tillgrain") is not None] * b.num_rows)], names=["x"])

assert not spark.range(1).mapInArrow(found, "x boolean").first().x, "the worker has the package"
from tillgrain.llm import queries
for name, query in queries.QUERIES.items():
    assert query(spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""


def test_queries_run_on_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT))], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert "all ran" in out.stdout, out.stderr[-3000:]
