"""Settings that the operators read from the session."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only where the session has none and runs in local mode a new temporary folder is set;
    on a cluster a folder of one machine would be of no use, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
        return found
    if spark.sparkContext.getCheckpointDir() is None:
        if not (spark.sparkContext.master or "").split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


_SCRATCH: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder of this application in the shared folder, for tables between two steps; it is deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        atexit.register(clear_scratch, spark)
    return _SCRATCH[app]


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the tables written so far; results that were not yet written or collected need them."""
    with contextlib.suppress(Exception):  # the session may have ended first
        folder = _SCRATCH.pop(spark.sparkContext.applicationId, None)
        if folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed and written to the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
