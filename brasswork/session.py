"""A session with the settings that every operator of the library assumes."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: UTC makes timestamps agree with engines that have no session zone; the adaptive planner joins small
#: partitions and splits skewed ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "brasswork", master: str | None = None, **extra: str) -> SparkSession:
    """The running session, or a new one. On a cluster the master and the sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    if master:
        cores = master.partition("[")[2].rstrip("]")
        shuffles = cores if cores.isdigit() else str(os.cpu_count() or 8)
        builder = builder.master(master).config("spark.sql.shuffle.partitions", shuffles)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share. Only a local session without one gets a temporary folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="brasswork-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut(frame: DataFrame) -> DataFrame:
    """frame, written once to the shared folder, so that several reads don't run its plan again."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()
