"""Session set-up and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: str | None = None) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("jobspectra")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording the Python call site of every Column costs more than short queries do.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("JOBSPECTRA_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", shuffle_partitions or cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset (tests on
    one machine) a fresh temporary folder stands in for it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        active = spark.sparkContext.getCheckpointDir()
        if active:
            return active
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="jobspectra-")
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame) -> DataFrame:
    """Reliable cut of the lineage: survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SCRATCH = "scratch-"


def scratch(df: DataFrame, name: str, *by: str) -> DataFrame:
    """An intermediate table in the shared folder, read back; ``by`` names its partition columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{_SCRATCH}{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; nothing read from them may be in use."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{_SCRATCH}{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
