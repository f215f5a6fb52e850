"""A file for each row, written by tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """Writes content (text or bytes) of df(name, content) to folder/name, and returns (name, bytes), which is done once that is computed.

    Names may have folders in them; they should be distinct. A file appears whole or not at all: it is written beside its place and
    then moved there, so that a task that runs again, or twice at once, does no harm.
    """
    from .files import opened

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        made: set[str] = set()
        for batch in batches:
            names, sizes = batch.column("name").to_pylist(), []
            for name, content in zip(names, batch.column("content"), strict=True):
                path = f"{base.rstrip('/')}/{name}"
                parent = path.rpartition("/")[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                data = content.as_py() or b""
                beside = f"{parent}/.{uuid.uuid4().hex}"
                with system.open_output_stream(beside) as file:
                    file.write(data)
                system.move(beside, path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return df.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string, bytes long")
