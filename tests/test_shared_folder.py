"""Folders of the local file system in a cluster: a shared mount is taken, a machine's own disk is refused."""

import os
import subprocess
import sys

JOB = """
import sys
from pyspark.sql import SparkSession
from gridcast import session

conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=conf | {"spark.checkpoint.dir": sys.argv[1]}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
spark.sparkContext.master = "spark://machine:7077"  # two executors with folders of their own, as on two machines
try:
    print("rows", session.stage(spark.range(100).repartition(5)).count())
except RuntimeError as refused:
    print("refused", refused)
spark.stop()
"""


def said(tmp_path, folder):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": repo, "SPARK_LOCAL_IP": "127.0.0.1"}
    (home := tmp_path / "home").mkdir()
    import pyspark

    for name in os.listdir(spark_home := os.path.dirname(pyspark.__file__)):
        if name != "work":  # the executors' folders
            (home / name).symlink_to(f"{spark_home}/{name}")
    run = subprocess.run([sys.executable, "-c", JOB, folder], env=env | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13"}, cwd=tmp_path, capture_output=True, text=True, timeout=200)
    return run.stdout or run.stderr


def test_a_mount_that_all_share_is_taken(tmp_path):
    assert "rows 100" in said(tmp_path, f"file://{tmp_path}/shared")


def test_a_disk_of_each_machine_is_refused(tmp_path):
    assert "refused" in said(tmp_path, "file:///proc/self/cwd/own")
