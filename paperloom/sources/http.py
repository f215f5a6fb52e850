"""HTTP for the connectors: one small client, and one that answers from recorded responses.

Service calls are made one after another on the driver: services limit requests, and many executors would only meet that limit
sooner. Distinct addresses are asked once, and the answers joined back to all rows. Answers that were gathered before are a table; they are
joined and read in tasks, and nothing passes through the driver.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import settings

# How states are named.
STATES = {200: "ok", 204: "no content", 400: "bad request", 401: "unauthorized", 403: "forbidden", 404: "not found", 405: "method not allowed", 409: "conflict", 410: "gone", 429: "too many requests"}


def state(code: int) -> str:
    return STATES.get(code, "server error" if 500 <= code <= 599 else f"error {code}")


@dataclass
class Response:
    status: int
    body: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)

    def json(self) -> Any:
        return json.loads(self.body)

    def text(self) -> str:
        return self.body.decode("utf-8", "replace")


class Client:
    """Real requests."""

    def __init__(self, timeout: float = 30):
        self.timeout = timeout

    def request(self, method: str, url: str, headers: dict[str, str] | None = None, data: bytes | None = None) -> Response:
        sent = urllib.request.Request(urllib.parse.quote(url, safe=":/?&=%#,;+@!*'()[]~$"), data=data, headers=headers or {}, method=method)
        try:
            with urllib.request.urlopen(sent, timeout=self.timeout) as got:
                return Response(got.status, got.read(), {k.lower(): v for k, v in got.headers.items()})
        except urllib.error.HTTPError as e:
            return Response(e.code, e.read(), {k.lower(): v for k, v in e.headers.items()})

    def get(self, url: str, headers: dict[str, str] | None = None) -> Response:
        return self.request("GET", url, headers)


class Recorded(Client):
    """Answers from a dictionary: url to JSON-ready value, text, bytes, Response, or a function of the request's data. Others are not found."""

    def __init__(self, answers: dict[str, Any]):
        super().__init__()
        self.answers, self.calls = answers, []

    def request(self, method: str, url: str, headers: dict[str, str] | None = None, data: bytes | None = None) -> Response:
        self.calls.append((method, url))
        if url not in self.answers:
            return Response(404)
        found = self.answers[url]
        found = found(data) if isinstance(found, Callable) else found
        if isinstance(found, Response):
            return found
        if isinstance(found, bytes):
            return Response(200, found)
        return Response(200, found.encode() if isinstance(found, str) else json.dumps(found).encode())


class Answers:
    """Answers that were gathered before, as a table: url, status (whole number), body (text). An address that isn't there was not found."""

    def __init__(self, table: DataFrame):
        self.table = table.select("url", F.col("status").cast("int").alias("status"), F.col("body").cast("string").alias("body"))

    def to(self, urls: DataFrame) -> DataFrame:
        """urls, with a column url, with status (404 if it isn't there) and body of each."""
        return urls.join(self.table, "url", "left").withColumn("status", F.coalesce("status", F.lit(404)))

    def records(self, urls: DataFrame, read: Callable[[str, int, str], dict[str, Any]], schema: str) -> DataFrame:
        """A row of the schema for each of urls(url), which read makes of address, status and body in tasks; fields that it leaves out are null."""
        fields = T._parse_datatype_string(schema).names

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = (read(*row) for row in batch[["url", "status", "body"]].itertuples(index=False, name=None))
                yield pd.DataFrame([[r.get(f) for f in fields] for r in rows], columns=fields, dtype=object)

        return self.to(urls.select("url").distinct()).mapInPandas(run, schema)


def site_down(url: str, error: bool = True, client: Client | None = None) -> bool:
    """Whether a site does not answer; an error, if asked for."""
    site = urllib.parse.urlsplit(url if "//" in url else f"https://{url}").netloc
    try:
        down = (client or Client()).request("HEAD", f"https://{site}").status >= 400
    except OSError:
        down = True
    if down and error:
        raise ConnectionError(f"The website {site} is not available")
    return down


def wait(seconds: float | None = None) -> None:
    if seconds := settings.osf_delay if seconds is None else seconds:
        time.sleep(seconds)


def frame(spark: SparkSession, rows: list[dict[str, Any]], schema: str) -> DataFrame:
    """Rows as a DataFrame; fields that a row lacks are null."""
    fields = T._parse_datatype_string(schema).names
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], schema)


def distinct_values(df: DataFrame, column: str, most: int = 100_000) -> list[str]:
    """The values of a column that a service is to be asked for; more than most is an error, for none would answer so many."""
    found = [r[0] for r in df.select(column).where(f"`{column}` IS NOT NULL").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} distinct values of {column} to ask a service for")
    return sorted(found)


def attach(table: DataFrame, found: DataFrame, left: str, right: str, suffix: str) -> DataFrame:
    """table with what was found for each of its values; names that are taken get a suffix."""
    renamed = found.withColumnsRenamed({c: f"{c}{suffix}" for c in found.columns if c in table.columns and c != right})
    renamed = renamed.withColumnRenamed(right, "_key")
    return table.join(renamed, table[left] == renamed["_key"], "left").drop("_key")
