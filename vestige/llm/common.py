"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows and bytes of one Arrow batch handed to Python; both bound a worker's memory.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Send the package to the Python workers and bound the Arrow batches that they get.

    Spark reads the bounds when a result is computed, so they can't be put back here; smaller ones that the session has
    already are left.
    """
    ship(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the cluster names in spark.checkpoint.dir. Only where that is unset, as in
    local tests, a folder under /tmp is taken.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        top = f"/tmp/vestige-checkpoints-{uuid.uuid4().hex[:8]}"
        spark.sparkContext.setCheckpointDir(top)
    return top.rstrip("/")


#: Tables that operators of this process wrote and that are still there, and by what table a DataFrame is read.
_written: list[str] = []


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables; to be called when the operators' results are written or no longer needed."""
    for path in [*_written]:
        delete(spark, path)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back; this cuts lineage.

    The table stays, as results are read from it later, until clear() is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: Column, text: Column) -> Column:
    """A key of the row's content: rows alike in id and text share it and get equal results."""
    return F.xxhash64(doc_id, text)
