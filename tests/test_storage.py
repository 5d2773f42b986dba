"""Stored tables on a cluster of executors."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

SCRIPT = """
import sys, time
from pyspark.sql import SparkSession
from pyrocline.storage import settle

folder = sys.argv[1]
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "700m").config("spark.ui.enabled", "false").config(
    "spark.executor.extraJavaOptions", f"-Xlog:gc:file={folder}/gc-%p.log").config("spark.driver.host", "127.0.0.1").config(
    "spark.checkpoint.dir", f"file://{folder}/shared").getOrCreate()
until = time.time() + 60
while spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() < 3 and time.time() < until:
    time.sleep(0.2)
print("ROWS", settle(spark.range(3), "three").count())
spark.stop()
"""


def test_executors_collect_garbage(tmp_path):
    home = tmp_path / "home"  # executors' logs go to work in Spark's home
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"PYTHONPATH": str(Path(__file__).parents[1]), "SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 3" in done.stdout, done.stderr[-2000:]
    logs = [p.read_text() for p in tmp_path.glob("gc-*.log")]
    assert len(logs) == 2 and all("(System.gc())" in x for x in logs)
