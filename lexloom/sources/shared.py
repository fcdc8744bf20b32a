"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def _base(spark: SparkSession) -> str:
    base = spark.conf.get(SETTING, None)
    if base:
        return base.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{SETTING} is not set: a cluster needs a folder that driver and executors share")
    # One machine: its own folder is shared by all, and goes with the process.
    made = tempfile.mkdtemp(prefix="lexloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return made


def session_dir(spark: SparkSession) -> str:
    """The folder that holds all tables of this application."""
    return f"{_base(spark)}/lexloom/{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one table."""
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts the lineage.

    The files outlive lost executors. `release` removes them once no result that reads them is needed.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than twice the cores in as many parts as there are cores, so that costly work on its rows isn't one task's.

    Scans of more splits, as all large ones are, stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def release(spark: SparkSession) -> None:
    """Removes all tables that this application has written by materialise; results that read them are void then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
