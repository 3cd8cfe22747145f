"""Functions that run in Python work on a user's own table, with the package only on the driver's path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
START = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
def session():
    b = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
    s = b.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    return s
"""


def ran(script, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", START + script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout.split()


def test_draws_and_scores(tmp_path):
    script = """
from cohortlens.operators import resample, scoring
s = session()
df = s.createDataFrame([(i % 2, i / 10) for i in range(10)], "y int, p double")
print(resample.multinomial_weights(resample.cells(df), 2).count() > 0)
s.stop()
s = session()
df = s.createDataFrame([([1.0, 2.0],)], "pixels array<double>")
print(scoring.score_batches(df, model, ["a"]).count())
"""
    helper = "def model():\n    return lambda x: x[:, :1]\n"
    assert ran(helper + script, tmp_path) == ["True", "1"]
