"""Helpers over ElementTree: names without namespaces, clean text, ancestors."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator


def parse(data: bytes) -> tuple[ET.Element, str]:
    """The root, its tags and attributes without namespaces, and the public name of the document type ("" if none)."""
    head = data[:4096].decode("utf-8", "replace")
    doctype = re.search(r"<!DOCTYPE[^>\"']*[\"']([^\"']*)[\"']", head, re.IGNORECASE)
    root = ET.fromstring(re.sub(rb"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", b"", data, count=1))
    for el in root.iter():
        if isinstance(el.tag, str) and "}" in el.tag:
            el.tag = el.tag.rpartition("}")[2]
        if el.attrib:
            for k in [k for k in el.attrib if "}" in k]:
                el.attrib[k.rpartition("}")[2]] = el.attrib.pop(k)
    return root, doctype[1] if doctype else ""


def squeeze(text: str) -> str:
    return " ".join(text.split())


def _link(el: ET.Element) -> str | None:
    """The address that a link element with text in it points to."""
    plain = not len(el) and (el.text or "") != ""
    if plain and el.tag == "ref" and el.get("type") == "url":
        return el.get("target")
    return el.get("href") if plain and el.tag == "ext-link" else None


def pieces(el: ET.Element, mark: ET.Element | None = None) -> Iterator[str]:
    """The text inside; links as <address>, sentence elements parted by spaces, and \\0 before and after a marked element."""
    if el is mark:
        yield "\0"
    if (target := _link(el)) is not None:
        yield f"<{target}>"
    else:
        yield el.text or ""
        for child in el:
            if isinstance(child.tag, str):
                yield from pieces(child, mark)
                if child.tag == "s":
                    yield " "
            yield child.tail or ""
    if el is mark:
        yield "\0"


def text(el: ET.Element | None, mark: ET.Element | None = None) -> str:
    if el is None:
        return ""
    if mark is None and not len(el) and el.tag not in ("ref", "ext-link"):  # most elements: nothing inside but text
        return squeeze(el.text or "")
    return squeeze("".join(pieces(el, mark)))


def find(root: ET.Element, path: str) -> list[ET.Element]:
    """All elements at the end of a chain of descendants, like "text body div", in document order, each once."""
    if " " not in path and "[" not in path:
        return [x for x in root.iter(path) if x is not root]
    found = [root]
    for step in path.split():
        tag, _, condition = step.partition("[")
        key, _, value = condition.rstrip("]").partition("=")
        seen: dict[int, ET.Element] = {}
        for el in found:
            for x in el.iter(tag):
                if x is not el and (not key or (key in x.attrib if not value else x.get(key) == value)):
                    seen.setdefault(id(x), x)
        found = list(seen.values())
    return found


def first(root: ET.Element | None, path: str) -> ET.Element | None:
    found = find(root, path) if root is not None else []
    return found[0] if found else None


def first_text(root: ET.Element | None, path: str) -> str:
    return text(first(root, path))


def texts(root: ET.Element, path: str) -> list[str]:
    return [text(x) for x in find(root, path)]


def parents(root: ET.Element) -> dict[ET.Element, ET.Element]:
    return {child: el for el in root.iter() for child in el}


def number(value: str | None) -> int | None:
    return int(value) if value and value.strip().lstrip("-").isdigit() else None
