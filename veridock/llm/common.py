"""What the operators of this subpackage share: key handling, batch sizes and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to a Python worker; texts may be very long.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def arrow_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, whatever the rows' length. All plans of this subpackage use the same bounds,
    so building one plan never changes the batches of another that has not run yet."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Where that is unset, a local session gets a
    temporary one; a cluster, whose executors would not see it, gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir() if hasattr(context, "getCheckpointDir") else None
        if not found:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            found = "file://" + tempfile.mkdtemp(prefix="veridock-")
            context.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, codec: str = "zstd", **options: int) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: lineage ends there and a lost executor loses
    nothing. ``discard`` deletes the files once nothing reads them any more; what a result still reads stays until the
    cluster's own cleaning of that folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veridock/{name}-{uuid.uuid4().hex}"
    df.write.options(compression=codec, **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.veridock_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables that ``written`` made; others are passed over."""
    for df in tables:
        path = getattr(df, "veridock_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def tidy(spark: SparkSession) -> None:
    """Let the driver collect what finished jobs left: Spark drops shuffle files and broadcasts, on all nodes, only once their
    handles are collected, which a driver that is not short of heap may put off for long."""
    spark._jvm.System.gc()


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text under fixed names, so that no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` under this module's batch bounds."""
    arrow_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(batches)

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
