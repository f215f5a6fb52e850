"""PDF files to TEI by a GROBID service."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path

from ..config import message
from .http import Client

SERVICE = "https://kermitt2-grobid.hf.space"


def _form(fields: dict[str, str], name: str, content: bytes) -> tuple[bytes, str]:
    """A multipart form with one file."""
    edge = uuid.uuid4().hex
    parts = [f'--{edge}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in fields.items()]
    file = f'--{edge}\r\nContent-Disposition: form-data; name="input"; filename="{name}"\r\nContent-Type: application/pdf\r\n\r\n'.encode() + content + b"\r\n"
    return b"".join([*parts, file, f"--{edge}--\r\n".encode()]), f"multipart/form-data; boundary={edge}"


def pdf_files(path: str) -> list[str]:
    return sorted(str(p) for p in Path(path).rglob("*") if p.suffix.lower() == ".pdf") if os.path.isdir(path) else [path]


def pdf2grobid(
    path: str | list[str], save_path: str = ".", url: str = SERVICE, start: int = -1, end: int = -1, consolidate_citations: int = 0, consolidate_header: int = 0,
    consolidate_funders: int = 0, client: Client | None = None,
) -> list[str | None]:
    """Converts PDF files, or all in a folder; returns the paths of the TEI files, None for those that failed."""
    if not re.match("https?://", url):
        raise ValueError("url must be a valid URL, starting with http or https!")
    client = client or Client(timeout=300)
    try:
        alive = client.get(f"{url}/api/isalive").status
    except OSError as e:
        raise ConnectionError(f"Connection to the GROBID server failed! Please check your connection or the URL: {url}") from e
    if alive != 200:
        raise ConnectionError(f"GROBID server does not appear up and running on the provided URL. Status: {alive}")
    files = pdf_files(path) if isinstance(path, str) else list(path)
    fields = {"start": start, "end": end, "consolidateCitations": consolidate_citations, "consolidateHeader": consolidate_header, "consolidateFunders": consolidate_funders, "includeRawCitations": 1}
    out: list[str | None] = []
    for file in files:
        if not os.path.isfile(file):
            raise FileNotFoundError(f"The file {file} does not exist.")
        body, kind = _form({k: str(v) for k, v in fields.items()}, os.path.basename(file), Path(file).read_bytes())
        got = client.request("POST", f"{url}/api/processFulltextDocument", {"Content-Type": kind}, body)
        single = len(files) == 1 and not os.path.isdir(save_path)
        target = re.sub(r"(\.xml)?$", ".xml", save_path, count=1) if single else os.path.join(save_path, f"{Path(file).stem}.xml")
        if got.status != 200:
            out.append(None)
            continue
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
        Path(target).write_bytes(got.body)
        out.append(target)
    message(f"{sum(x is not None for x in out)} out of {len(files)} PDF files successfully converted to TEI XML.")
    return out
