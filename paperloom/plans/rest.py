"""What a web service over these operators answers: functions from an uploaded file to JSON-ready values. Any server can mount them."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators.search import RETURNS, search_text
from ..operators.tables import author_table, info_table
from ..schemas import Corpus
from ..sources.parsed import PARSED, parsed_row
from ..sources.reader import corpus_of
from .modules import module_find, module_list, module_run

#: Bytes of the largest upload.
MOST_BYTES = 3 << 20
#: Rows of the largest answer; a larger one is an error, never cut.
MOST_ROWS = 10_000


class RequestError(ValueError):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise RequestError(413, f"The answer has more than {MOST_ROWS} rows; search for less, or a part of the paper")
    return [r.asDict(recursive=True) for r in rows]


def upload(spark: SparkSession, name: str, content: bytes) -> Corpus:
    """The paper in an uploaded XML file."""
    if not content:
        raise RequestError(400, "No file was uploaded")
    if len(content) > MOST_BYTES:
        raise RequestError(413, f"The file is larger than {MOST_BYTES >> 20} MB")
    if not re.search(r"\.xml$", name, re.IGNORECASE):
        raise RequestError(415, "The file must be XML")
    row = parsed_row(name, content)  # one file of a few MB
    if row["error"]:
        raise RequestError(500, f"The file could not be read: {row['error']}")
    return corpus_of(spark.createDataFrame([row], PARSED))


def health() -> dict[str, Any]:
    return {"status": "ok", "modules": [m["name"] for m in module_list()]}


def info(paper: Corpus, fields: str = "title,keywords,doi,description") -> list[dict]:
    return _rows(info_table(paper, [f.strip() for f in fields.split(",")]))


def authors(paper: Corpus) -> list[dict]:
    return _rows(author_table(paper))


def references(paper: Corpus) -> list[dict]:
    return _rows(paper.bib)


def cross_references(paper: Corpus) -> list[dict]:
    return _rows(paper.xrefs)


def search(paper: Corpus, pattern: str, return_: str = "sentence", section: str | None = None) -> list[dict]:
    if not pattern:
        raise RequestError(400, "The parameter pattern is missing")
    if return_ not in RETURNS:
        raise RequestError(400, f"The parameter return must be one of {', '.join(RETURNS)}")
    try:
        return _rows(search_text(paper, pattern, section=section, return_=return_))
    except ValueError as e:
        raise RequestError(400, str(e)) from e


def module(paper: Corpus, name: str, **options) -> dict[str, Any]:
    try:
        module_find(name)
    except LookupError as e:
        raise RequestError(400, str(e)) from e
    result = module_run(paper, name, **options)
    return {"module": name, "title": result.title, "traffic_light": result.traffic_light, "report": result.report, "table": _rows(result.table) if result.table is not None else [], "summary": _rows(result.summary)}


def check(paper: Corpus, names: str = "exact_p,marginal,effect_size,statcheck,ref_consistency") -> dict[str, Any]:
    """Several modules; one that fails says so."""
    out = {}
    for name in (n.strip() for n in names.split(",")):
        try:
            out[name] = module(paper, name)
        except RequestError:
            raise
        except Exception as e:
            out[name] = {"module": name, "traffic_light": "fail", "report": str(e)}
    return out


ROUTES = {
    "GET /health": health,
    "POST /paper/info": info,
    "POST /paper/authors": authors,
    "POST /paper/references": references,
    "POST /paper/cross-references": cross_references,
    "POST /paper/search": search,
    "POST /paper/module": module,
    "POST /paper/check": check,
}

