"""Results that are computed once, written to the shared folder, and read again wherever they are needed."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..streaming.files import shared_dir

_made: list[str] = []
_kept: list[DataFrame] = []


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df as a Parquet table, without lineage to lose. Filters on partition_by read only the files that they need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """df persisted until release(): for what is small and read a few times, such as what a search has found."""
    _kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def release(spark: SparkSession) -> None:
    """Deletes the tables made so far, and lets go of what is kept. Call it when no DataFrame that reads them is needed any more."""
    while _kept:
        _kept.pop().unpersist()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
