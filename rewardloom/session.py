"""Session settings and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Reward columns are large expressions; recording the Python call site of every node doubles their building time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(app: str, cpus: int | str = "*", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, in the partitions Spark cuts it into.

    Scans are cut by bytes and at most into row groups, which suits large tables. Where small files have to keep many
    cores busy, the setting ``spark.rewardloom.scanPartitions`` spreads their rows over so many partitions.
    """
    table = spark.read.parquet(path)
    wanted = spark.conf.get("spark.rewardloom.scanPartitions", None)
    return table.repartition(int(wanted)) if wanted else table


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's ``spark.checkpoint.dir``, or below its warehouse where that is unset.

    Both are folders that all executors share; on a cluster, whose default warehouse is a folder of the driver's machine, one of
    them must be set. The folder is deleted when the driver ends.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") and not context.getConf().contains("spark.sql.warehouse.dir"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{base.rstrip('/')}/rewardloom/{name}-{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder
