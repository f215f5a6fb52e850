"""Files of papers in folders, found and parsed in tasks, and the data source "papers".

found_files lists folders in tasks, level by level, so that names pass neither through the driver nor through one task.
A file that can't be opened or parsed is a row with an error.

    spark.dataSource.register(PaperSource)
    spark.read.format("papers").option("paths", '["/papers"]').load()

is for folders whose names fit the driver: they are listed once, where the plan is made, and packed into partitions by their bytes,
in the order of their paths, so that neither many small files nor a few large ones make tasks that differ much.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from contextlib import suppress
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from .parsed import PARSED, parsed_row
from .stored import stored

#: Endings of files that are read.
KNOWN = re.compile(r"\.(xml|txt|docx)$", re.IGNORECASE)
#: Bytes of a partition, and what opening a file costs in bytes.
PARTITION, OPEN = 16 << 20, 64 << 10
#: Bytes of files, and of opening them, whose rows are handed over at once.
BATCH = 4 << 20
#: Tasks that files and folders are dealt over at most, as the driver keeps some KB of each. A task holds no more than a batch, however many files it reads.
TASKS = 1024
#: What is in folders: files, and folders without bytes. root: the address whose file system has the path.
FOUND = "root string, path string, bytes bigint"


def opened(path: str):
    """A file system and the path on it, for addresses that Arrow knows."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if re.match(r"file:|[^:]*$", path):
        return LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return FileSystem.from_uri(path)


def reachable(path: str) -> bool:
    """Whether a path is a file or folder that the data source can open; other paths are left to Spark's own sources."""
    from pyarrow.fs import FileType

    try:
        system, name = opened(path)
        return system.get_file_info(name).type != FileType.NotFound
    except (OSError, ValueError, NotImplementedError):
        return False


def listed(paths: Iterable[str]) -> list[tuple[str, str, int]]:
    """(root, name, bytes) of the files in folders and below, each once. root: the address whose file system has the name."""
    from pyarrow.fs import FileSelector, FileType

    out = {}
    for path in paths:
        system, name = opened(path)
        info = system.get_file_info(name)
        found = [info] if info.type == FileType.File else system.get_file_info(FileSelector(name, recursive=True))
        out |= {x.path: (path, x.path, x.size or 0) for x in found if x.type == FileType.File and KNOWN.search(x.path)}
    return [out[k] for k in sorted(out)]


def within(system, path: str) -> Iterator[tuple[str, int | None]]:
    """(path, bytes) of a file, or of the files in a folder, and (path, None) of the folders in it. Local folders are read on as they are listed."""
    from pyarrow.fs import FileSelector, FileType, LocalFileSystem

    if isinstance(system, LocalFileSystem) and os.path.isdir(path):
        with os.scandir(path) as entries:
            for x in entries:
                if x.is_dir():
                    yield x.path, None
                elif KNOWN.search(x.name) and x.is_file():
                    with suppress(FileNotFoundError):  # it may go meanwhile
                        yield x.path, x.stat().st_size
        return
    info = system.get_file_info(path)
    for x in [info] if info.type == FileType.File else system.get_file_info(FileSelector(path)):
        if x.type == FileType.Directory:
            yield x.path, None
        elif x.type == FileType.File and KNOWN.search(x.path):
            yield x.path, x.size or 0


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for root, path in zip(batch.column("root").to_pylist(), batch.column("path").to_pylist(), strict=True):
            system, name = opened(root)
            entries = within(system, name if path is None else path)
            while part := list(islice(entries, 10_000)):
                paths, sizes = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([root] * len(part)), pa.array(paths), pa.array(sizes, pa.int64())], names=["root", "path", "bytes"])


def found_files(spark: SparkSession, paths: list[str], most: int = PARTITION) -> DataFrame:
    """FOUND of the files in folders and below, each once, dealt over as many tasks as their bytes need, up to TASKS. The driver sees numbers only."""
    out, level = spark.createDataFrame([], FOUND), spark.createDataFrame([(x, None, None) for x in paths], FOUND)
    folders, number, size = len(paths), 0, 0
    while folders:
        table = stored(level.repartition(min(folders, TASKS)).mapInArrow(_list, FOUND), "found")
        out, level = out.union(table.where("bytes IS NOT NULL")), table.where("bytes IS NULL")
        folders, more, bytes_ = table.agg(F.count_if(F.col("bytes").isNull()), F.count("bytes"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        number, size = number + more, size + bytes_
    tasks = max(1, min(number, TASKS, -(-(size + number * OPEN) // most)))
    return (out if len(paths) == 1 else out.dropDuplicates(["path"])).repartition(tasks)


def parsed_files(files: Iterable[tuple[str, str, int]]) -> Iterator[pa.RecordBatch]:
    """PARSED of files (root, path, bytes), opened one by one."""
    schema, rows, size = to_arrow_schema(PARSED), [], 0
    for root, name, length in files:
        try:
            with opened(root)[0].open_input_stream(name) as file:
                rows.append(parsed_row(name, file.read()))
        except OSError as e:
            rows.append(parsed_row(name, None, e))
        size += length + OPEN
        if size >= BATCH:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def parse_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PARSED of FOUND."""
    return parsed_files(file for batch in batches for file in zip(*(batch.column(c).to_pylist() for c in ("root", "path", "bytes")), strict=True))


def packed(files: Iterable[tuple[str, str, int]], most: int) -> list[list[tuple[str, str, int]]]:
    """Consecutive files, at most so many bytes together, or one file."""
    out: list[list] = []
    room = 0
    for file in files:
        cost = file[2] + OPEN
        if not out or cost > room:
            out.append([])
            room = most
        out[-1].append(file)
        room -= cost
    return out


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, int]]):
        super().__init__(files)
        self.files = files


class PaperReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.most = int(options.get("partitionbytes", PARTITION))

    def partitions(self) -> list[Files]:
        return [Files(x) for x in packed(listed(self.paths), self.most)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return parsed_files(partition.files)


class PaperSource(DataSource):
    """A row of PARSED for each file. Options: paths (a JSON list of files and folders), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "papers"

    def schema(self):
        return PARSED

    def reader(self, schema) -> PaperReader:
        return PaperReader(self.options)
