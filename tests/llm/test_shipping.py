"""Every operator where only the driver has this package: workers get their functions by value."""

import os
import subprocess
import sys
from pathlib import Path

from loomgraph.llm.registry import queries

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", "file://{here}/shared").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
from loomgraph.llm.registry import queries
for name, query in queries().items():
    print(name, query(spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_from_a_foreign_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT), here=str(tmp_path))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-3000:]
    found = dict(line.split() for line in out.stdout.splitlines() if line.startswith("op"))
    assert len(found) == len(queries()) and all(int(n) > 0 for n in found.values())
