"""What the engine asks of a session."""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, and gives checkpoints a folder.

    The folder is that of spark.checkpoint.dir; a temporary one only where that is unset on a local
    master, as in tests.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
            import tempfile

            folder = tempfile.mkdtemp(prefix="loom-")
        spark.sparkContext.setCheckpointDir(folder)
    return spark
