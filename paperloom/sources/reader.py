"""Files of papers as the tables of a corpus.

Files are found, read and parsed in tasks, one row each; a file that can't be read is a row with an error, and no more. What one
pass over the files gives is written to the shared folder as a table partitioned by kind (file, text, bib, xref), from which
each of the five tables reads its own kind alone. To keep a corpus, write it: Corpus.write.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.sections import locate_xrefs, number_paragraphs, process_full_text
from ..schemas import Corpus
from .files import PARTITION, found_files, parse_found, reachable
from .parsed import PARSED, parsed_row
from .stored import stored

#: Bytes of content whose rows are handed over at once.
BATCH = 4 << 20


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(PARSED)
    for batch in batches:
        rows, size = [], 0
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            data = content.as_py()
            rows.append(parsed_row(path.as_py(), data))
            size += len(data or b"")
            if size >= BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def parse_files(files: DataFrame, deal: bool = True) -> DataFrame:
    """PARSED, a row for each of files(path, content). deal: over tasks first; not needed if the files come from a source that has packed them."""
    files = files.select("path", "content")
    return (files.repartition("path") if deal else files).mapInArrow(_parse, PARSED)


def path_parts(column: str) -> Column:
    return F.split(F.regexp_replace(column, r"(?i)\.(xml|txt|docx)$", ""), "/")


def file_ids(paths: DataFrame, column: str = "path") -> tuple[DataFrame, Column]:
    """paths, and each one's id: its parts that differ among the paths, without the ending."""
    rows = paths.withColumn("_parts", path_parts(column))
    depth = rows.agg(F.max(F.size("_parts"))).first()[0] or 1
    # Least and largest of each part: a handful, in one pass without a shuffle of paths.
    part = lambda k: F.coalesce(F.get("_parts", F.lit(k)), F.lit("\0"))
    differs = rows.agg(*((F.min(part(k)) != F.max(part(k))).alias(f"n{k}") for k in range(depth))).first()
    varying = [k for k in range(depth) if differs[f"n{k}"]] or [None]
    last = F.element_at("_parts", -1)
    id_ = last if varying == [None] else F.array_join(F.array_compact(F.array(*(F.get("_parts", F.lit(k)) for k in varying))), "/")
    return rows, id_


def by_kind(parsed: DataFrame) -> DataFrame:
    """(kind, path, seq, and error, info and authors of a file, or one of its paragraphs, references or citations) of PARSED, in one pass."""
    types = {f.name: f.dataType for f in PARSED.fields}
    item = {"file": None, "text": types["paragraphs"].elementType, "bib": types["bib"].elementType, "xref": types["xrefs"].elementType}

    def row(kind: str, seq: Column, value: Column | None = None) -> Column:
        whole = [F.col(c) if kind == "file" else F.lit(None).cast(types[c]).alias(c) for c in ("error", "info", "authors")]
        parts = [(value if k == kind else F.lit(None).cast(t)).alias(k) for k, t in item.items() if t is not None]
        return F.struct(F.lit(kind).alias("kind"), seq.cast("bigint").alias("seq"), *whole, *parts)

    each = lambda column, kind: F.coalesce(F.transform(column, lambda x, k: row(kind, k, x)), F.array())
    rows = F.concat(F.array(row("file", F.lit(0))), each("paragraphs", "text"), each("bib", "bib"), each("xrefs", "xref"))
    return parsed.select("path", F.explode(rows).alias("x")).select("path", "x.*")


def _corpus(table: DataFrame, ids_of: DataFrame | None) -> Corpus:
    """The tables of a stored by_kind()."""
    _, id_ = file_ids((table.where("kind = 'file' AND error IS NULL") if ids_of is None else ids_of).select("path"))
    table = table.withColumn("_parts", path_parts("path")).withColumn("id", id_).drop("_parts")
    of = lambda kind: table.where(F.col("kind") == kind)
    files = of("file").where("error IS NULL")
    paragraphs = of("text").select("id", "seq", "text.*")
    structured = paragraphs.where("is_header IS NULL").drop("is_header")
    flat = number_paragraphs(paragraphs.where("is_header IS NOT NULL").select("id", "seq", "text", "is_header"), F.col("is_header")).drop("is_header")
    columns = ["id", "seq", "header", "text", "div", "p", "section"]
    # Paragraphs are dealt by paper once, before they are cut: every window of sentences is inside a paper.
    full_text = process_full_text(structured.select(columns).unionByName(flat.select(columns)).repartition("id"))
    xrefs = of("xref").select("xref.*", "id").withColumns({c: F.lit(None).cast("string") for c in ("section", "div", "p", "s")})
    return Corpus(files.select("id", F.col("path").alias("filename"), "info.*"), files.select("id", "authors"), full_text, of("bib").select("bib.*", "id"), locate_xrefs(xrefs, full_text))


def corpus_of(parsed: DataFrame, files: DataFrame | None = None) -> Corpus:
    """The tables of parsed files, which are parsed once. Files with errors are left out.

    files: the table with the column path that ids are told apart by; if not given, the files without errors.
    """
    return _corpus(stored(by_kind(parsed), "parsed", "kind"), files)


def files_source(spark: SparkSession, paths: list[str], partition_bytes: int | None = None) -> DataFrame:
    """PARSED of the files in folders and below. Paths that only Spark can open, and patterns, are read by its own source of files."""
    if all(reachable(p) for p in paths):
        return found_files(spark, paths, partition_bytes or PARTITION).mapInArrow(parse_found, PARSED)
    known = r"(?i)\.(xml|txt|docx)$"
    return parse_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).where(F.col("path").rlike(known)), deal=False)


def read(spark: SparkSession, path: str | list[str], partition_bytes: int | None = None) -> Corpus:
    """The papers in files, or in all files with known endings in folders and below."""
    paths = [path] if isinstance(path, str) else list(path)
    table = stored(by_kind(files_source(spark, paths, partition_bytes)), "parsed", "kind")
    files, bad = table.where("kind = 'file'").agg(F.count(F.lit(1)), F.count("error")).first()
    if not files:
        raise ValueError(f"There are no xml, docx or txt files in {', '.join(paths)}")
    if bad:
        import warnings

        warnings.warn(f"{bad} files did not read correctly", stacklevel=2)
    return _corpus(table, None)


def read_errors(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, error) of the files that can't be read."""
    return files_source(spark, [path] if isinstance(path, str) else list(path)).where("error IS NOT NULL").select("path", "error")


read_grobid = read_cermine = read_text = read
