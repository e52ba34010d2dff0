"""The folder that driver and executors share."""

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a folder of our own, in local mode only: on a cluster other machines would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _own.get(context.applicationId) or _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="tidings-"))
    return path.rstrip("/")


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one for the steps of a run. It goes when the driver ends; a driver that is killed leaves it."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder
