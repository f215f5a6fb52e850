"""What the parsers give for a file, as a row."""

from __future__ import annotations

from pyspark.sql import types as T

from ..schemas import AUTHOR, BIB_COLUMNS
from .documents import parse_document

INFO = ("title", "description", "doi", "submission", "received", "accepted", "revised", "pub_print", "pub_online")


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


PARAGRAPH = T.StructType([*_strings("header", "text"), T.StructField("div", T.IntegerType()), T.StructField("p", T.IntegerType()), *_strings("section"), T.StructField("is_header", T.BooleanType())])
PARSED = T.StructType(
    [
        *_strings("path", "error"),
        T.StructField("info", T.StructType([*_strings(*INFO), T.StructField("keywords", T.ArrayType(T.StringType()))])),
        T.StructField("authors", T.ArrayType(AUTHOR)),
        T.StructField("paragraphs", T.ArrayType(PARAGRAPH)),
        T.StructField("bib", T.ArrayType(T.StructType(_strings(*BIB_COLUMNS[:-1])))),
        T.StructField("xrefs", T.ArrayType(T.StructType(_strings("xref_id", "type", "contents", "text")))),
    ]
)


def _only(record: dict, names) -> dict:
    return {n: record.get(n) for n in names}


def parsed_row(path: str, content: bytes | None, error: Exception | None = None) -> dict:
    """A row of PARSED. Whatever is wrong with a file is that file's error, and no more."""
    row = dict.fromkeys(PARSED.names)
    row["path"] = path
    try:
        if error:
            raise error
        doc = parse_document(path, bytes(content or b""))
        row["info"] = {**_only(doc["info"], INFO), "keywords": doc["info"].get("keywords", [])}
        row["authors"], row["paragraphs"] = doc["authors"], doc["paragraphs"]
        row["bib"] = [_only(x, BIB_COLUMNS[:-1]) for x in doc["bib"]]
        row["xrefs"] = doc["xrefs"]
    except Exception as e:
        row["error"] = f"{type(e).__name__}: {e}"[:500]
    return row
