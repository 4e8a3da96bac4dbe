import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from pagewright.streaming.token_bucket import limit_requests
from pagewright.streaming.throttle import throttle_log
df = spark.range(20).selectExpr("'k' AS k", "id", "timestamp_micros(id) AS ts")
print("allowed", limit_requests(df, "k", "ts", "id", F.lit(10)).filter("allowed").count(), throttle_log(df, "k", "ts", "id").filter("emitted").count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """A plain session started elsewhere: its Python workers cannot import the package."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "allowed 10 1" in out.stdout, out.stderr[-2000:]
