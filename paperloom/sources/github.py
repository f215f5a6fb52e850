"""GitHub repositories: readme, files, languages."""

from __future__ import annotations

import base64
import os
import re
from typing import Any

from ..config import message
from .http import Client
from .osf import _filetype

API = "https://api.github.com/repos"
# Fixed value: owner and name in an address.
REPO = r"(?:^|/)([a-z0-9-]+/[a-z0-9._-]+?)(?=\.git(?:/|$)|/|$)"


def github_config() -> dict[str, str]:
    token = os.environ.get("GITHUB_PAT") or os.environ.get("GITHUB_TOKEN")
    return {"Accept": "application/vnd.github.v3+json", "User-Agent": "paperloom", **({"Authorization": f"token {token}"} if token else {})}


def repo_name(address: str) -> str | None:
    """owner/name in an address or a name."""
    rest = re.sub(r"^.*github\.com[/:]", "", address.strip(), flags=re.IGNORECASE)
    m = re.search(REPO, rest, re.IGNORECASE)
    return m[1] if m else None


def github_repo(address: str, client: Client | None = None) -> str:
    """owner/name if there is such a repository, else "unavailable"."""
    name = repo_name(address)
    if not name or (client or Client()).request("HEAD", f"https://github.com/{name}").status != 200:
        return "unavailable"
    return name


def github_readme(address: str, client: Client | None = None) -> str:
    got = (client or Client()).get(f"{API}/{repo_name(address)}/readme", github_config())
    return base64.b64decode(got.json()["content"]).decode("utf-8", "replace") if got.status == 200 else ""


def github_files(address: str, folder: str = "", recursive: bool = False, client: Client | None = None) -> list[dict[str, Any]]:
    """name, path, size, ext and type of the files in a folder, and below if recursive. What was listed before a limit is kept."""
    client, out, folders = client or Client(), [], [folder]
    while folders:
        got = client.get(f"{API}/{repo_name(address)}/contents/{folders.pop(0)}", github_config())
        if got.status != 200:
            message("Rate limit exceeded" if got.headers.get("x-ratelimit-remaining") == "0" else f"{folder}: error {got.status}")
            break
        rows = []
        for x in got.json():
            name = re.sub(r"/+", "/", x["name"]).strip("/")
            ext = name.rsplit(".", 1)[1].lower() if "." in name else ""
            rows.append({"name": name, "path": x["path"], "size": x["size"], "ext": ext, "type": (ext and _filetype(name)) or x["type"], "_dir": x["type"] == "dir"})
        rows.sort(key=lambda r: r["path"])
        if recursive:
            folders = [r["path"] for r in rows if r["_dir"]] + folders
        out += rows
    return [{k: v for k, v in r.items() if k != "_dir"} for r in out]


def github_languages(address: str, client: Client | None = None) -> list[dict[str, Any]]:
    got = (client or Client()).get(f"{API}/{repo_name(address)}/languages", github_config())
    return [{"language": k, "bytes": v} for k, v in got.json().items()] if got.status == 200 else []


def github_info(address: str, recursive: bool = False, client: Client | None = None) -> dict[str, Any]:
    return {
        "repo": github_repo(address, client),
        "readme": github_readme(address, client),
        "files": github_files(address, recursive=recursive, client=client),
        "languages": github_languages(address, client),
    }
