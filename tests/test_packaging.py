"""The package reaches workers that are started elsewhere."""
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from revspark.session import get_spark
from revspark.operators.structure import extract_elements
spark = get_spark("local[1]", shuffle_partitions=1)
files = spark.createDataFrame([(1, "a.py", "def f(): pass")], "review_id long, file_path string, code string")
print("ROWS", extract_elements(files).count())
"""


def test_jobs_started_outside_the_repository(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 2" in done.stdout, done.stderr[-2000:]
