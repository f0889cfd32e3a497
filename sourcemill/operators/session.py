"""Checkpoints in the folder that the session names."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to ``spark.checkpoint.dir`` with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (context.master or "").split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


#: Tasks that the rows of one split of a table are dealt to.
SHARE = 8


def tasks_for(*tables: DataFrame) -> int:
    """Partitions to deal the rows of tables to: as many as the session says, and more where they have many splits.

    tables are read from files without a shuffle. The number grows with them, so what one task holds does not.
    """
    session = max(1, int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(session, SHARE * sum(t.rdd.getNumPartitions() for t in tables))


_SCRATCH: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A folder of this application in the shared folder, for tables that grow round by round; it is deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = f"{shared_dir(spark).rstrip('/')}/rounds-{uuid.uuid4().hex}"
        atexit.register(clear_scratch, spark)
    return _SCRATCH[app]


def clear_scratch(spark: SparkSession) -> None:
    """Deletes those tables; results that were not yet written or collected need them."""
    with contextlib.suppress(Exception):  # the session may have ended first
        folder = _SCRATCH.pop(spark.sparkContext.applicationId, None)
        if folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Grown:
    """A table that rounds append to: every row is written once, in the round that found it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.parts, self.schema = spark, f"{scratch(spark)}/{uuid.uuid4().hex}", 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Writes df and returns it read again."""
        path = f"{self.folder}/part-{self.parts:06d}"
        df.write.parquet(path)
        self.parts, self.schema = self.parts + 1, df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.folder)
