"""The folder that the driver and all executors share, and cutting lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as a URI with its scheme; in local mode, where that is unset, a folder of the session's own."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir isn't set: the operators need a folder that all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='docloom-')}")
        found = context.getCheckpointDir()
    path = context._jvm.org.apache.hadoop.fs.Path(found)
    whole = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed now and kept in the shared folder: neither its plan nor a lost executor costs more than a read later on."""
    shared_dir(df.sparkSession)  # sets one in local mode
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
