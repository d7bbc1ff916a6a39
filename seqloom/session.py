"""Session factory and the two helpers every operator shares: reading a table and cutting lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL = 1_000_000  # numbers that a table may hold to be broadcast


def get_session(app: str = "seqloom", cores: str = "*", partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution; on a cluster the submitter's own settings win."""
    return (
        SparkSession.builder.master(os.environ.get("SPARK_MASTER", f"local[{cores}]"))
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which all executors share: the session's, or for a local session without one a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="seqloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there: a later stage survives lost executors and doesn't run df again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame, size: Column | None = None) -> DataFrame:
    """df, checkpointed already, with a hint to broadcast it if the sum of size (of numbers in a row, 1 by default) over its rows is SMALL at most."""
    total = df.agg(F.coalesce(F.sum(F.lit(1) if size is None else size), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= SMALL else df


_stored: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """df written as a Parquet table to the shared folder and read from there. Unlike a checkpoint it is compressed, and columns that a plan doesn't
    read aren't loaded. The table stays until release()."""
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def scratch(spark: SparkSession) -> str:
    """The name of a new folder in the shared one, which release() deletes."""
    _stored.append(f"{shared_folder(spark)}/table-{uuid.uuid4().hex}")
    return _stored[-1]


def release(spark: SparkSession, but: int = 0) -> None:
    """Deletes what stored() wrote, but for the last tables."""
    while len(_stored) > but:
        path = spark._jvm.org.apache.hadoop.fs.Path(_stored.pop(0))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
