"""What the operators share: temporary tables, and words of many texts at once as numpy arrays."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; bounds the numpy arrays of a Python worker.
SLICE = 2 << 20

# ---------------------------------------------------------------- temporary tables

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for temporary tables: spark.checkpoint.dir; set here only on local masters, where it may be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return base


def unique(path: str) -> str:
    return f"{path}-{uuid.uuid4().hex}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a temporary table in the shared folder."""
    path = unique(f"{shared_dir(spark).rstrip('/')}/{name}")
    _made.append(path)
    return path


def as_table(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: computed once, and without lineage to lose."""
    path = new_path(df.sparkSession, name)
    out = df.write
    if partition_by:
        out = out.partitionBy(partition_by)
    out.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, name: str, keys: list[str]) -> Iterator[DataFrame]:
    """df as a table in the shared folder, bucketed by keys, so that joins on them leave it where it is; forgotten by the catalog afterwards."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(shuffle_partitions(spark), *keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs as a table with a number for each row, and the number's column: once written, a row keeps it in all that reads it."""
    column = free_name(docs, "_rid")
    return as_table(docs.withColumn(column, F.monotonically_increasing_id()), name), column


def release(spark: SparkSession) -> None:
    """Deletes the temporary tables made so far. Call it once the results that read them are stored."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_size(docs: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of text."""
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    return rows, int(size or 0)


def crc_remainder(column: str, mod: int):
    """crc32 of the id as text, modulo mod; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


# ---------------------------------------------------------------- Arrow text as bytes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing; every byte of a character above 7F counts.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words [^\x20\x09-\x0D]+.
NONSPACE = np.ones(256, bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and the offset of each text in them (one more than texts); null is empty."""
    if column.type not in (pa.large_binary(), pa.binary()):
        column = column.cast(pa.large_string())
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch, column: str = "text", most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows of a batch with at most so many bytes of text, or one row, with buffers() of the column."""
    data, offsets = buffers(batch.column(column))
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(low: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and the index of each text's first word (one more than texts)."""
    word = kind[low]
    first = np.zeros(len(low) + 1, bool)
    first[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


# ---------------------------------------------------------------- 64-bit hashes, equal in all processes

_R = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i for i < n, modulo 2**64."""
    if len(_powers[0]) < n:
        n = max(n, SLICE + 1)
        for k, r in enumerate((_R, pow(_R, -1, 1 << 64))):
            base = np.full(n, r, np.uint64)
            base[0] = 1
            _powers[k] = np.multiply.accumulate(base)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each bit over the whole number."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(low: np.ndarray) -> np.ndarray:
    """Sums of byte times power, from which the hash of any span follows."""
    power, _ = powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, np.uint64)
    x = low.astype(np.uint64)
    x += np.uint64(1)
    x *= power[: len(low)]
    np.cumsum(x, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, whatever its place."""
    _, inverse = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


_EIGHT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, short: int = 64) -> np.ndarray:
    """A hash of each span of bytes, eight bytes at a time with a mix after each, so that no repeated pattern cancels out.

    Spans above short bytes get a cryptographic one, each by itself.
    """
    size = ends - starts
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix(size.astype(np.uint64) + np.uint64(_R))
    live, at = np.flatnonzero((size > 0) & (size <= short)), 0
    while len(live):
        block = eights[starts[live] + at] & _EIGHT[np.minimum(size[live] - at, 8)]
        out[live] = mix((out[live] ^ block) * np.uint64(0xD6E8FEB86659FD93))
        at += 8
        live = live[size[live] > at]
    for k in np.flatnonzero(size > short).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def named_words(low: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each word (equal numbers, equal bytes), a hash for each number, and the index of each text's first word."""
    starts, ends, first = word_spans(low, offsets, kind)
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    body = low[kind[low]]
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(body)]).dictionary_encode()
    data, at = buffers(coded.dictionary)
    return coded.indices.to_numpy(), byte_hashes(data, at[:-1], at[1:]), first


def fold(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive hashes."""
    size = max(0, len(h) - n + 1)
    t = h[:size].copy()
    for j in range(1, n):
        t *= np.uint64(0xD6E8FEB86659FD93)
        t += h[j : j + size]
        t = mix(t)
    return t


def ranges(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each, count numbers long, after each other."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(firsts - before, counts) + np.arange(total)


def binary_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Spans of bytes as an Arrow array."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    if len(starts) and np.array_equal(starts[1:], ends[:-1]):
        body = np.ascontiguousarray(data[starts[0] : ends[-1]])
    else:
        body = data[ranges(starts, lengths)]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def with_columns(batch, **columns) -> pa.RecordBatch:
    """The batch with further columns."""
    arrays, names = list(batch.columns), list(batch.schema.names)
    for name, values in columns.items():
        arrays.append(values if isinstance(values, pa.Array) else pa.array(values))
        names.append(name)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def vocabulary(path: str) -> bytes:
    """A vocabulary file, read on the driver; it is broadcast, as executors may not have it. Such files have a few MB."""
    with open(path, "rb") as file:
        return file.read()


def public_vocabulary(name: str) -> str:
    """The path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
