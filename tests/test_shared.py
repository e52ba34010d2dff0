"""Folders of a run in the shared folder."""

import os
import subprocess
import sys
import time

CODE = """
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "file://{0}").config("spark.ui.enabled", "false").getOrCreate()
from tidings.operators.graph import cut
x = cut(s.range(3).toDF("id"))
import os
assert x.count() == 3 and any(f.startswith("cut-") for f in os.listdir("{0}"))
open("{0}/mine", "w").close()
s.stop()
"""


def test_folders_go_with_the_driver_and_nothing_else(tmp_path):
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    subprocess.run([sys.executable, "-c", CODE.format(tmp_path)], check=True, env=env, timeout=120)
    # the driver's JVM may outlive the Python process by a moment
    for _ in range(100):
        left = os.listdir(tmp_path)
        if not any(f.startswith("cut-") for f in left):
            break
        time.sleep(0.2)
    assert "mine" in left and not any(f.startswith("cut-") for f in left)
