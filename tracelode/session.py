"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "8192",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tracelode")
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    # Local tables are small; smaller partitions keep all local threads busy.
    builder = builder.config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
    builder = builder.config("spark.sql.files.openCostInBytes", "262144")
    builder = builder.config("spark.driver.memory", "12g")
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is the cluster's `spark.checkpoint.dir`. Only where that is unset and everything runs in one
    local process, as in tests, a temporary folder is taken and remembered on the session; on a
    cluster its executors would each write to a disk of their own, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("tracelode.scratch.dir", None)
    if not path:
        require_local(spark.sparkContext.master)
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("tracelode.scratch.dir", path)
    return path


def require_local(master: str) -> None:
    """Fail unless driver and executors are one process."""
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(
            f"spark.checkpoint.dir is not set, and {master} has executors that do not share this machine's folders"
        )


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: store `df` in the shared folder and read it back.

    Unlike a checkpointed RDD the stored table is columnar and has sizes the optimizer can use.
    """
    return write_table(df, "cut")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder once and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
