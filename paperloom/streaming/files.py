"""Searches over files as they arrive: the batch operators' row-wise parts on a stream of text files.

A match depends on its own row alone, so matches need no state and no watermark. Counts by document are kept in the state
store, and are bounded by the documents seen.
"""

from __future__ import annotations

import atexit
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import java_pattern


#: Folders of this machine, which go when the process ends.
_local: set[str] = set()


def text_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string", max_files: int = 1) -> DataFrame:
    """A stream of the rows of Parquet files in a folder, or that a pattern names."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_matches(stream: DataFrame, pattern: str, id_column: str = "doc_id", ignore_case: bool = True) -> DataFrame:
    """(id, text) of each match."""
    java = java_pattern(stream.sparkSession, pattern, ignore_case)
    return stream.where(F.col("text").rlike(java)).select(F.col(id_column).cast("string").alias("id"), F.explode(F.regexp_extract_all("text", F.lit(java), F.lit(0))).alias("text"))


def stream_counts(stream: DataFrame, pattern: str, id_column: str = "doc_id", ignore_case: bool = True) -> DataFrame:
    """(id, matches): for output modes update and complete."""
    return stream_matches(stream, pattern, id_column, ignore_case).groupBy("id").agg(F.count(F.lit(1)).alias("matches"))


def run_available(stream: DataFrame, sink_path: str, checkpoint: str) -> None:
    """Writes what has arrived to Parquet, each row once, and ends."""
    stream.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def shared_dir(spark: SparkSession) -> str:
    """Where streams keep their state: spark.checkpoint.dir; a folder of this machine only where nothing else runs."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    if folder not in _local:
        _local.add(folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"
