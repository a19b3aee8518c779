"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder if all runs in one process (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_own_shared_dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="peltrane-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark._own_shared_dir = found
        spark.sparkContext.setCheckpointDir(found)
    return found
