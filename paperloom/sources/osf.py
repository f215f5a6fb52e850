"""The Open Science Framework: links in papers, and what they lead to."""

from __future__ import annotations

import json
import os
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import message, settings
from ..functions.ids import FILE_TYPES, osf_id
from ..operators.search import expand_text, search_text
from ..schemas import Corpus, null_safe_join
from .http import Answers, Client, attach, distinct_values, frame, state, wait

# Links in text, with or without an address for viewing only, and the kinds of entries in the order asked for.
LINK = r"\bosf\s*\.\s*io\s*/\s*[a-z0-9]{5}\s*/?\s*\??\b"
VIEW_ONLY = r"\bosf\s*\.\s*io\s*/\s*[a-z0-9]{5}\s*/\s*\?\s*view_only\s*=\s*[0-9a-f]+"
KINDS = ("nodes", "files", "preprints", "registrations", "users")
SCHEMA = (
    "osf_id string, name string, description string, osf_type string, public boolean, category string, registration boolean, preprint boolean, parent string, "
    "kind string, filetype string, size long, downloads long, download_url string, provider string, doi string, version int, is_published boolean, "
    "date_created string, date_modified string, primary_file string, orcid string"
)


def osf_delay(seconds: float | None = None) -> float:
    """Gets or sets the seconds between requests."""
    if seconds is not None:
        if isinstance(seconds, bool) or not isinstance(seconds, int | float):
            raise ValueError("set osf_delay with a numeric value for the number of seconds to wait between OSF calls")
        settings.osf_delay = float(seconds)
    return settings.osf_delay


def osf_api_calls(calls: int | None = None) -> int:
    """Gets or sets the count of requests."""
    if calls is not None:
        if not isinstance(calls, int):
            raise ValueError("set osf_api_calls with a numeric value (usually reset to 0)")
        settings.osf_calls = calls
    return settings.osf_calls


def osf_headers() -> dict[str, str]:
    token = os.environ.get("OSF_PAT")
    return {"User-Agent": "paperloom", "Accept-Header": "application/vnd.api+json", **({"Authorization": f"Bearer {token}"} if token else {})}


def _get(client: Client, url: str):
    wait()
    settings.osf_calls += 1
    return client.get(url, osf_headers())


def osf_api_check(client: Client | None = None) -> str:
    try:
        return state(_get(client or Client(), settings.osf_api).status)
    except OSError:
        return "no internet"


def osf_links(source: Corpus | DataFrame) -> DataFrame:
    """Each OSF link in the text. One that ends with a question mark goes on, often in the next sentence, and is completed from there."""
    links = search_text(source, LINK, return_="match")
    cut = links.where(F.col("text").contains("?")).distinct()
    whole = search_text(expand_text(cut, source, plus=1).withColumn("_link", F.col("text")).withColumn("text", F.col("expanded")), VIEW_ONLY, return_="match")
    whole = whole.select(*(c for c in links.columns if c not in ("text", "seq")), F.col("_link").alias("text"), F.col("text").alias("_whole"))
    keys = [c for c in links.columns if c != "seq"]
    out = null_safe_join(links, whole.groupBy(*keys).agg(F.min("_whole").alias("_whole")), keys, "left")
    return out.withColumn("text", F.coalesce("_whole", "text")).drop("_whole")


def osf_check_id(spark: SparkSession, values: list[str | None]) -> list[str | None]:
    """The OSF id in each text, or None."""
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.id for r in rows.select("k", osf_id(F.col("v")).alias("id")).orderBy("k").collect()]


def _dig(data: Any, *keys: str) -> Any:
    for k in keys:
        data = data.get(k) if isinstance(data, dict) else None
    return data


def _filetype(name: str | None) -> str | None:
    ext = (name or "").rsplit(".", 1)[-1].lower()
    return ";".join(k for k, v in FILE_TYPES.items() if ext in v.split()) or None


def entry(data: dict) -> dict[str, Any]:
    """A row for one entry of any kind, from its JSON."""
    att, kind, related = data.get("attributes") or {}, data.get("type"), lambda *k: _dig(data, "relationships", *k, "data", "id")
    row = {"osf_id": data.get("id"), "osf_type": kind, "name": att.get("title") or att.get("name") or att.get("full_name"), "description": att.get("description")}
    row |= {c: att.get(c) for c in ("public", "category", "registration", "preprint")}
    if kind == "nodes":
        row["parent"] = related("parent")
    elif kind == "files":
        row |= {"kind": att.get("kind"), "size": att.get("size"), "downloads": _dig(att, "extra", "downloads"), "download_url": _dig(data, "links", "download")}
        row["parent"] = related("parent_folder") or related("target")
        row["filetype"] = _filetype(att.get("name")) if att.get("kind") == "file" else None
    elif kind == "preprints":
        row |= {c: att.get(c) for c in ("doi", "version", "is_published", "date_created", "date_modified")}
        row |= {"provider": related("provider"), "parent": related("node"), "primary_file": _dig(data, "relationships", "primary_file", "links", "related", "href")}
    elif kind == "registrations":
        row |= {"category": "registration", "parent": related("registered_from")}
    elif kind == "users":
        row |= {"public": True, "orcid": _dig(att, "social", "orcid")}
    return row


def osf_info(id_: str, client: Client | None = None) -> dict[str, Any]:
    """The entry with an id: each kind is asked for until one is found."""
    client = client or Client()
    message(f"* Retrieving info from {id_}...")
    for kind in KINDS:
        got = _get(client, f"{settings.osf_api}/{kind}/{id_}")
        if got.status == 200:
            data = got.json()
            if not data.get("errors"):
                return entry(data["data"])
        elif got.status == 401:
            return {"osf_id": id_, "osf_type": "private", "public": False}
        elif got.status == 429:
            return {"osf_id": id_, "osf_type": "too many requests"}
        elif got.status != 404:
            break
    return {"osf_id": id_, "osf_type": "unfound"}


def _gathered(ids: DataFrame, answers: Answers) -> DataFrame:
    """SCHEMA of ids(_osf) from answers that were gathered before: of each id's kinds, in order, the first that doesn't say it isn't there."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("order"), F.lit(kind).alias("kind")) for k, kind in enumerate(KINDS)))).alias("x")
    urls = ids.select(F.col("_osf").alias("osf_id"), kinds).select("osf_id", "x.order", F.concat(F.lit(f"{settings.osf_api}/"), "x.kind", F.lit("/"), "osf_id").alias("url"))
    there = (F.col("status") != 404) & ~((F.col("status") == 200) & F.get_json_object("body", "$.errors").isNotNull())
    first = answers.to(urls).where(there).groupBy("osf_id").agg(F.min_by(F.struct("url", "status", "body"), "order").alias("got"))
    found = ids.select(F.col("_osf").alias("osf_id")).join(first, "osf_id", "left").select(F.col("osf_id").alias("url"), F.coalesce("got.status", F.lit(404)).alias("status"), "got.body")

    def read(id_: str, status: int, body: str) -> dict[str, Any]:
        if status == 200:
            return {**entry(json.loads(body)["data"]), "osf_id": id_}
        return {"osf_id": id_, "osf_type": {401: "private", 429: "too many requests"}.get(status, "unfound")} | ({"public": False} if status == 401 else {})

    return Answers(found).records(found, read, SCHEMA)


def osf_get_all_pages(url: str, page_end: float = float("inf"), client: Client | None = None) -> list[dict]:
    """The data of a listing and its further pages."""
    out, client = [], client or Client()
    while url:
        got = _get(client, url)
        if got.status != 200:
            break
        content = got.json()
        out += content.get("data") or []
        url = _dig(content, "links", "next")
        page = re.search(r"[?&]page=(\d+)", url or "")
        if not page or int(page[1]) > page_end:
            break
    return out


def osf_children(id_: str, client: Client | None = None) -> list[dict]:
    return [entry(x) for x in osf_get_all_pages(f"{settings.osf_api}/nodes/{id_}/children/", client=client)]


def osf_files(id_: str, client: Client | None = None) -> list[dict]:
    """The files of a project (in each of its stores) or of a folder."""
    base = f"{settings.osf_api}/nodes/{id_}/files/" if len(id_) == 5 else f"{settings.osf_api}/files/{id_}/"
    found = osf_get_all_pages(base, client=client)
    found = found if isinstance(found, list) else [found]
    links = [_dig(x, "relationships", "files", "links", "related", "href") for x in found]
    return [{**entry(x), "parent": id_} for url in links if url for x in osf_get_all_pages(url, client=client)]


def osf_parent_project(id_: str, client: Client | None = None) -> str:
    """The project at the top, above an entry."""
    seen = set()
    while id_ not in seen:
        seen.add(id_)
        above = osf_info(id_, client).get("parent")
        if not above:
            break
        id_ = above
    return id_


def contents(ids: list[str], client: Client | None = None, recursive: bool = False) -> list[dict]:
    """Entries with their components and files below them, breadth first. Stops where the service asks for fewer requests."""
    rows = []
    for id_ in ids:
        rows.append(osf_info(id_, client))
        if rows[-1]["osf_type"] == "too many requests":
            break
    if not recursive:
        return rows
    level, seen = [r for r in rows if r.get("osf_type") == "nodes"], set(ids)
    below: list[dict] = []
    while level:
        level = [c for r in level for c in osf_children(r["osf_id"], client) if c["osf_id"] not in seen and not seen.add(c["osf_id"])]
        below += level
    folders = [r["osf_id"] for r in rows + below if r.get("osf_type") == "nodes" or r.get("kind") == "folder"]
    while folders:
        files = [f for x in folders for f in osf_files(x, client) if f["osf_id"] not in seen and not seen.add(f["osf_id"])]
        below += files
        folders = [f["osf_id"] for f in files if f.get("kind") == "folder"]
    return rows + below


def osf_retrieve(source: DataFrame, column: str = "osf_url", recursive: bool = False, find_project: bool = False, client: Client | Answers | None = None) -> DataFrame:
    """A table of links with what each leads to. recursive: rows for all components and files below, too. find_project: the project at the top of each.

    client: what asks the service, or Answers that were gathered before (then neither of the two is possible; trees.descendants()
    finds what is below entries whose parents are in a table).
    """
    if isinstance(client, Answers):
        if recursive or find_project:
            raise ValueError("answers that were gathered before can't be asked for more")
        known = source.withColumn("_osf", osf_id(F.col(column)))
        found = _gathered(known.select("_osf").where("_osf IS NOT NULL").distinct(), client)
        return attach(known, found.withColumn("_id", F.col("osf_id")), "_osf", "_id", ".osf").drop("_osf")
    client = client or Client()
    if (status := osf_api_check(client)) != "ok":
        raise ConnectionError(f"The OSF API seems to be having a problem: {status}\nCheck {settings.osf_api}")
    spark = source.sparkSession
    known = source.withColumn("_osf", osf_id(F.col(column)))
    ids = distinct_values(known, "_osf")
    rows = contents(ids, client, recursive)
    if find_project:
        tops: dict[str, str] = {}
        for r in rows:
            above = r.get("parent")
            if above and above not in tops:
                tops[above] = osf_parent_project(above, client)
            r["project"] = tops.get(above) if above else r["osf_id"] if r.get("osf_type") == "nodes" else None
    found = frame(spark, rows, SCHEMA + (", project string" if find_project else ""))
    asked = spark.createDataFrame([(x,) for x in ids], "osf_id string")
    own = found.join(asked, "osf_id", "left_semi")
    out = attach(known, own.withColumn("_id", F.col("osf_id")), "_osf", "_id", ".osf").drop("_osf")
    if recursive:
        out = out.unionByName(found.join(asked, "osf_id", "left_anti"), allowMissingColumns=True)
    return out


def osf_preprint_list(
    provider: str | list[str] | None = None, date_created: str | tuple[str, str] | None = None, date_modified: str | tuple[str, str] | None = None,
    page_start: int = 1, page_end: int | None = None, client: Client | None = None,
) -> list[dict]:
    """Preprints by provider and date (one day, or from and to)."""
    filters = [f"page={page_start}"]
    if provider:
        filters.append(f"filter[provider]={provider if isinstance(provider, str) else ','.join(provider)}")
    for name, value in (("date_created", date_created), ("date_modified", date_modified)):
        if isinstance(value, str):
            filters.append(f"filter[{name}]={value}")
        elif value:
            filters += [f"filter[{name}][gte]={min(value)}", f"filter[{name}][lte]={max(value)}"]
    found = osf_get_all_pages(f"{settings.osf_api}/preprints/?{'&'.join(filters)}", page_start if page_end is None else page_end, client)
    return [entry(x) for x in found]


def choose_files(files: list[dict], max_file_size: float | None = 10, max_download_size: float = 100) -> list[dict]:
    """Files up to a size (MB), the largest left out until the rest fits the total."""
    mb = 1024 * 1024
    kept = sorted((f for f in files if not max_file_size or (f.get("size") or 0) <= max_file_size * mb), key=lambda f: (f.get("size") or 0, f["osf_id"]))
    while kept and sum(f.get("size") or 0 for f in kept) > max_download_size * mb:
        kept.pop()
    return kept


def osf_file_download(
    id_: str, download_to: str = ".", max_file_size: float | None = 10, max_download_size: float = 100, max_folder_length: int | None = None,
    ignore_folder_structure: bool = False, client: Client | None = None,
) -> list[dict]:
    """Downloads a project's files into a new folder, and returns a row for each file: folder, name, path, downloaded."""
    client = client or Client()
    rows = contents([id_], client, recursive=True)
    by_id = {r["osf_id"]: r for r in rows}
    files = [r for r in rows if r.get("kind") == "file"]
    if not files:
        return []
    safe = lambda x: re.sub(r"[/\\?%*:|\"<>\x00-\x1f]", "", x or "")
    target, n = os.path.join(download_to, id_) if os.path.isdir(download_to) else download_to, 0
    base = target
    while os.path.isdir(target):
        n += 1
        target = f"{base}_{n}"
    os.makedirs(target)

    def place(f: dict) -> str:
        if ignore_folder_structure:
            same = [x for x in files if x["name"] == f["name"]]
            stem, dot, ext = safe(f["name"]).rpartition(".")
            return safe(f["name"]) if len(same) == 1 else f"{stem or ext}_{f['parent']}{dot}{ext if stem else ''}"
        folders, above = [], f.get("parent")
        while above and above != id_ and above in by_id:
            folders.append(safe(by_id[above]["name"])[:max_folder_length])
            above = by_id[above].get("parent")
        return os.path.join(safe(rows[0].get("name") or id_), *reversed(folders), safe(f["name"]))

    chosen, out = {f["osf_id"] for f in choose_files(files, max_file_size, max_download_size)}, []
    for f in files:
        row = {"folder": os.path.basename(target), **{c: f.get(c) for c in ("osf_id", "name", "filetype", "size", "downloads")}, "path": None, "downloaded": False}
        if f["osf_id"] in chosen and f.get("download_url"):
            got = client.get(f["download_url"])
            if got.status == 200:
                row |= {"path": place(f), "downloaded": True}
                os.makedirs(os.path.dirname(os.path.join(target, row["path"])), exist_ok=True)
                with open(os.path.join(target, row["path"]), "wb") as file:
                    file.write(got.body)
        out.append(row)
    return out
