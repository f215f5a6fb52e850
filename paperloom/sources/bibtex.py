"""BibTeX files: reading, writing, and adding DOIs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_columns import few_values
from .http import Client
from .scholarly import bibsearch, short_doi

_ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s]+)\s*,", re.MULTILINE)


def _values(body: str) -> dict[str, str]:
    """Fields of an entry: in braces, which may nest, in quotes, or bare."""
    out, at = {}, 0
    while m := re.compile(r"\s*,?\s*([\w-]+)\s*=\s*").match(body, at):
        at = m.end()
        if at < len(body) and body[at] == "{":
            depth, start = 0, at
            while at < len(body):
                depth += {"{": 1, "}": -1}.get(body[at], 0)
                at += 1
                if not depth:
                    break
            value = body[start + 1 : at - 1]
        elif at < len(body) and body[at] == '"':
            end = body.find('"', at + 1)
            end = len(body) if end < 0 else end
            value, at = body[at + 1 : end], end + 1
        else:
            bare = re.compile(r"[^,}\s]*").match(body, at)
            value, at = bare[0], bare.end()
        out[m[1].upper()] = re.sub(r"\s+", " ", re.sub(r"[{}]", "", value)).strip()
    return out


def parse_bibtex(source: str) -> list[dict[str, str]]:
    """An entry is a dictionary: CATEGORY, BIBTEXKEY and its fields, names in capitals."""
    starts = list(_ENTRY.finditer(source))
    ends = [m.start() for m in starts[1:]] + [len(source)]
    return [{"CATEGORY": m[1].upper(), "BIBTEXKEY": m[2], **_values(source[m.end() : end])} for m, end in zip(starts, ends, strict=True) if m[1].lower() not in ("comment", "string", "preamble")]


def format_bibtex(entries: list[dict[str, str]]) -> str:
    block = lambda e: f"@{e['CATEGORY'].capitalize()}{{{e['BIBTEXKEY']},\n" + ",\n".join(f"  {k.capitalize()} = {{{v}}}" for k, v in e.items() if k not in ("CATEGORY", "BIBTEXKEY") and v) + "\n}\n"
    return "\n".join(map(block, entries))


def _fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"fields": [e for source in batch["source"] if source for e in parse_bibtex(source)]}, dtype=object)


def bibtex_fields(df: DataFrame, column: str) -> DataFrame:
    """(fields): a map for each entry in a column of BibTeX sources; a null or empty source has none."""
    return df.select(F.col(column).alias("source")).mapInPandas(_fields, "fields map<string, string>")


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """The entries of .bib files, with a column for each field; what an entry lacks is null. More than MOST names of fields are an error."""
    entries = bibtex_fields(spark.read.text(path, wholetext=True), "value")
    first = ["CATEGORY", "BIBTEXKEY"]
    names = few_values(entries.select(F.explode(F.map_keys("fields")).alias("name")), "name")
    return entries.select(*(F.col("fields")[n].alias(n) for n in first + [n for n in names if n not in first]))


def bibtex_add_dois(path: str, save_to: str | None = None, strict: bool = True, client: Client | None = None) -> list[dict[str, str]]:
    """Adds DOIs to the articles of a .bib file that have none, writes the file anew, and returns its entries."""
    with open(path, encoding="utf-8") as file:
        entries = parse_bibtex(file.read())
    for e in entries:
        if not e.get("DOI") and e["CATEGORY"] == "ARTICLE" and e.get("TITLE"):
            found = bibsearch(e["TITLE"], e.get("JOURNAL"), strict, client)
            if found and found.get("doi"):
                e["DOI"] = short_doi(found["doi"])
    with open(save_to or re.sub(r"\.bib$", "_doi.bib", path), "w", encoding="utf-8") as file:
        file.write(format_bibtex(entries))
    return entries
