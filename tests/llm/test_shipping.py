"""Tasks must not need the package: they are run where workers can't import it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from alertspark.session import get_spark
from alertspark.llm.queries import QUERIES
import corpus_pipeline

spark = get_spark("local[4]", 4)
seen = spark.range(1).mapInArrow(lambda bs: ([b for b in bs if __import__("importlib.util").util.find_spec("alertspark") is None]), "id long").count()
assert seen == 1, "workers can import the package here"
for name, query in {**QUERIES, "pipeline": corpus_pipeline.run}.items():
    n = query(spark, "/root/testdata/sf0.001").count()
    assert n > 0 or name in ("op5_benchmark_leaks", "op12_cover_negatives"), name
    print("ran", name, n, flush=True)
"""


def test_queries_run_where_workers_lack_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", SCRIPT, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert got.returncode == 0, got.stdout + got.stderr[-3000:]
    assert got.stdout.count("ran ") == 14
