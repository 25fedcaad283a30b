"""Functions for the executors work wherever the driver was started."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from tessera.operators.neutral import neutralized
rows = spark.range(40).select(F.lit("2025-01-01").cast("date").alias("trade_date"), F.col("id").cast("string").alias("symbol"), (F.col("id") * 1.0).alias("value"))
risk = rows.select("trade_date", "symbol", (F.col("value") % 7).alias("size"), F.array(F.lit("a")).alias("industries"))
print("ROWS", neutralized(rows, risk, ["size"], [], 10).where("value is not null").count())
"""


def test_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS 40" in done.stdout, done.stderr[-2000:]
