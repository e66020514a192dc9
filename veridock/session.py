"""Session and table access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def local_session(cores: int | None = None, app: str = "veridock", memory: str = "8g") -> SparkSession:
    """A local session as tests and the benchmark use it; clusters bring their own."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; Spark reads only the columns and row groups that a plan needs."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share (``spark.checkpoint.dir``), which is also where checkpoints go.
    Where none is named, a local session gets a temporary one; a cluster gets an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veridock-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return f"{found.rstrip('/')}/veridock/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a table below the shared folder and read it back: what was read from texts once is not read again by every plan
    that uses it, and plans stay short."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt out over all cores where it has fewer tasks than that, as expensive expressions over a small file would all
    run in one. Plans with a shuffle of their own, and large tables, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan" or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
