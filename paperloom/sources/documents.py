"""Parsers for scholarly documents: TEI, JATS (two dialects), Word and plain text.

Each gives the paper's info, authors, paragraphs, bibliography and cross-references as plain Python values, which the reader
turns into tables. Sentences and sections come later, in Spark.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from datetime import date, datetime

from .markup import find, first, first_text, number, parents, parse, squeeze, text, texts

Paragraph = dict


def paragraph(header: str | None, body: str, div: int | None, p: int | None, section: str | None = None, is_header: bool | None = None) -> Paragraph:
    return {"header": header, "text": body, "div": div, "p": p, "section": section, "is_header": is_header}


def _block(header: str, bodies: list[str], div: int, section: str | None = None) -> list[Paragraph]:
    """A header as paragraph 0, and the paragraphs under it."""
    return [paragraph(header, x, div, k, section) for k, x in enumerate([header, *bodies])]


def _abstract(root: ET.Element) -> list[Paragraph]:
    return [paragraph("Abstract", x, 0, k) for k, x in enumerate(texts(root, "abstract p"), 1)]


# ---------------------------------------------------------------- dates

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
DATE = re.compile(rf"(?:{_MONTH}|\d{{1,4}})[- /.](?:{_MONTH}|\d{{1,2}}),?[- /.]\d{{2,4}}", re.IGNORECASE)


def to_date(value: str) -> date | None:
    """A date from parts in the order year month day, day month year or month day year; years of two digits lie before next year."""
    parts = re.split(r"[- /.,]+", value.strip())
    if len(parts) != 3:
        return None
    named = [k for k, x in enumerate(parts) if x[:3].lower() in MONTHS]
    try:
        if named:
            month = MONTHS.index(parts[named[0]][:3].lower()) + 1
            others = [int(x) for k, x in enumerate(parts) if k != named[0]]
            year, day = (others[0], others[1]) if others[0] > 31 else (others[1], others[0])
        else:
            numbers = [int(x) for x in parts]
            if numbers[0] > 31:
                year, month, day = numbers
            else:
                month, day, year = numbers
                if month > 12:
                    month, day = day, month
        if year < 100:
            year += 2000 if 2000 + year <= datetime.now().year else 1900
        return date(year, month, day)
    except ValueError:
        return None


def submission_dates(note: str) -> dict[str, str]:
    """received and accepted: the first date after each word."""
    out = {}
    for word in ("received", "accepted"):
        at = note.lower().find(word)
        if at >= 0:
            for m in DATE.finditer(note, at):
                found = to_date(m[0])
                out[word] = found.isoformat() if found else m[0]
                break
    return out


def jats_date(el: ET.Element | None) -> str | None:
    """Year, month and day elements as an ISO date."""
    if el is None:
        return None
    month = first(el, "month")
    y, d = number(first_text(el, "year")), number(first_text(el, "day"))
    m = number(month.get("number") or text(month)) if month is not None else None
    return f"{y}-{m:02d}-{d:02d}" if y is not None and m is not None and d is not None else None


# ---------------------------------------------------------------- sentences of cross-references

_SENTENCE = re.compile(r"(?<=[!?.])\s+(?=[^a-z]*[A-Z])")


def sentence_with(parent: ET.Element, mark: ET.Element) -> str:
    """The sentence of the parent's text that an element begins in."""
    body = re.sub(r"\b([A-Z])\.", r"\1", text(parent, mark))
    for sentence in _SENTENCE.split(body):
        if "\0" in sentence:
            return squeeze(sentence.replace("\0", ""))
    return squeeze(body.replace("\0", ""))


def _sorted_xrefs(rows: list[dict]) -> list[dict]:
    rows = [dict(x) for x in dict.fromkeys(tuple(r.items()) for r in rows)]
    digits = lambda r: int(re.sub(r"\D", "", r["xref_id"] or "")[:9] or 0)
    return sorted(rows, key=lambda r: (r["type"] or "", digits(r)))


# ---------------------------------------------------------------- TEI


def tei_info(root: ET.Element) -> dict:
    note = first_text(root, "sourceDesc note[type=submission]")
    return {
        "title": first_text(root, "titleStmt title"),
        "description": "\n\n".join(texts(root, "abstract p")),
        "keywords": texts(root, "keywords term"),
        "doi": first_text(root, "sourceDesc idno[type=DOI]"),
        "submission": note or None,
        **submission_dates(note),
    }


def _author(surname: str, given: str, email: str | None = None, orcid: str | None = None, affiliation: list[dict] = ()) -> dict:
    return {"orcid": orcid or None, "name": {"surname": surname, "given": given}, "roles": [], "email": email or None, "affiliation": list(affiliation)}


def tei_authors(root: ET.Element) -> list[dict]:
    out = []
    for a in find(root, "sourceDesc author"):
        if a.find("persName") is not None:
            places = [{x.get("type") or "": text(x) for x in find(aff, "orgName")} for aff in find(a, "affiliation")]
            out.append(_author(" ".join(texts(a, "surname")), " ".join(texts(a, "forename")), ";".join(texts(a, "email")), first_text(a, "idno[type=ORCID]"), places))
    return out


def _id_parts(value: str | None) -> tuple[str | None, int | None]:
    """"fig_3" as its kind and number."""
    m = re.fullmatch(r"(.*?)_(\d+)", value or "")
    return (m[1], int(m[2])) if m else (value, None)


def tei_paragraphs(root: ET.Element) -> list[Paragraph]:
    out = _abstract(root)
    divs = find(root, "text body div")
    for k, div in enumerate(divs, 1):
        head = first(div, "head")
        out += _block(f"[div-{k:02d}]" if head is None else text(head), texts(div, "p"), k)
    last = len(divs)
    kinds = dict.fromkeys(d.get("type") for d in find(root, "back div") if d.get("type") not in (None, "references"))
    for kind in kinds:
        for div in find(root, f"back div[type={kind}] div"):
            last += 1
            out += _block(first_text(div, "head"), texts(div, "p"), last, kind)
    for fig in find(root, "figure"):
        kind, n = _id_parts(fig.get("id"))
        out.append(paragraph(first_text(fig, "head"), first_text(fig, "figDesc"), n, 1, kind))
    for note in find(root, "note[place=foot]"):
        kind, n = _id_parts(note.get("id"))
        out.append(paragraph("", text(note), n, None, kind))
    return out


def tei_xrefs(root: ET.Element) -> list[dict]:
    above, out = parents(root), []
    for ref in root.iter("ref"):
        if ref.get("type") != "url" or len(ref):
            target = ref.get("target")
            contents, parent = text(ref), above[ref]
            if not contents or not text(parent):
                continue
            out.append({"xref_id": target.removeprefix("#") if target else None, "type": ref.get("type"), "contents": contents, "text": sentence_with(parent, ref)})
    return _sorted_xrefs(out)


def _people(ref: ET.Element, role: str) -> list[str]:
    return [" ".join(filter(None, [" ".join(texts(p, "forename")), " ".join(texts(p, "surname"))])) for p in find(ref, f"{role} persName")]


def bib_entry(ref: ET.Element) -> dict:
    """A reference as a BibTeX-like entry: article with a journal, incollection within a book, book, else misc."""
    optional = lambda path: first_text(ref, path) or None
    imprint = first(ref, "imprint")
    within = lambda path: (first_text(imprint, path) or None) if imprint is not None else None
    entry = {
        "doi": optional("idno[type=DOI]"),
        "title": optional("title[level=a]"),
        "author": _people(ref, "author"),
        "editor": _people(ref, "editor"),
        "journal": optional("title[level=j]"),
        "booktitle": optional("title[level=m]"),
        "publisher": within("publisher"),
        "year": within("date[type=published]"),
        "volume": within("biblScope[unit=volume]"),
        "number": within("biblScope[unit=issue]"),
    }
    pages = first(imprint, "biblScope[unit=page]") if imprint is not None else None
    if pages is not None:
        entry["pages"] = text(pages) or "-".join(filter(None, [pages.get("from"), pages.get("to")])) or None
    kind = "misc"
    if entry["journal"]:
        kind = "article"
        entry["year"] = entry["year"] or optional("note") or "no year"
    elif entry["booktitle"]:
        kind = "incollection"
        if not entry["title"]:
            kind, entry["title"], entry["booktitle"] = "book", entry["booktitle"], None
    return {"bibtype": kind, **{k: v for k, v in entry.items() if v}}


def citation(entry: dict) -> str:
    """An entry as one line of text."""
    people = entry.get("author", [])
    names = ", ".join(people[:-1]) + (" and " if len(people) > 1 else "") + people[-1] if people else ""
    out = [f"{names} ({entry['year']})." if entry.get("year") else f"{names}." if names else ""]
    if title := entry.get("title"):
        out.append(f"“{title}.”")
    if entry.get("booktitle"):
        out.append(f"In {entry['booktitle']}.")
    where = entry.get("journal") or entry.get("publisher")
    volume = entry.get("volume", "") + (f"({entry['number']})" if entry.get("number") else "")
    tail = ", ".join(filter(None, [where, volume, entry.get("pages")]))
    out += [f"{tail}." if tail else "", f"doi:{entry['doi']}." if entry.get("doi") else ""]
    return squeeze(" ".join(out))


def tei_bib(root: ET.Element) -> list[dict]:
    out = []
    for ref in find(root, "listBibl biblStruct"):
        e = bib_entry(ref)
        out.append(
            {
                "xref_id": ref.get("id"), "ref": citation(e) or text(ref), "doi": e.get("doi"), "bibtype": e["bibtype"], "title": e.get("title"),
                "journal": e.get("journal"), "year": e.get("year"), "authors": ", ".join(e.get("author", [])) or None,
            }
        )
    return out


def app_info(root: ET.Element) -> dict:
    """Which program made a TEI file."""
    app = first(root, "appInfo application")
    ref = first(app, "ref") if app is not None else None
    return {"version": app.get("version") if app is not None else None, "when": app.get("when") if app is not None else None, "url": ref.get("target") if ref is not None else None}


# ---------------------------------------------------------------- JATS


def jats_info(root: ET.Element, apa: bool) -> dict:
    out = {"title": first_text(root, "article-title") if apa else first_text(root, "front article-title"), "description": "\n\n".join(texts(root, "abstract p"))}
    out["keywords"] = [x.removeprefix("eol>") for x in texts(root, "kwd-group kwd")]
    if not apa:
        return {**out, "doi": first_text(root, "front pub-id[pub-id-type=doi]") or first_text(root, "front article-id[pub-id-type=doi]")}
    out["doi"] = first_text(root, "article-id[pub-id-type=doi]")
    for name, path in (("pub_print", "pub-date[pub-type=print]"), ("pub_online", "pub-date[pub-type=online]")):
        found = first(root, path)
        out[name] = jats_date(first(found, "string-date") if found is not None and first(found, "string-date") is not None else found)
    for name in ("received", "revised", "accepted"):
        out[name] = jats_date(first(root, f"history string-date[content-type={name}]"))
    return out


# Fixed value: particles that belong to a surname.
PARTICLES = ("van der ", "van ", "de la ", "de ", "della ")


def _split_name(name: str) -> tuple[str, str]:
    m = re.search(rf" (?:{'|'.join(PARTICLES)})?\S+$", " " + name, re.IGNORECASE)
    surname = m[0].strip() if m else name
    return surname, name[: len(name) - len(surname)].strip()


def jats_authors(root: ET.Element, apa: bool) -> list[dict]:
    out = []
    affiliations = {x.get("id"): x for x in root.iter("aff")}
    if apa:
        for a in find(root, "contrib-group[content-type=primary-authors] contrib[contrib-type=author]"):
            places = [{"": text(affiliations[r])} for r in (a.get("rid") or "").split() if r in affiliations]
            orcid = first_text(a, "contrib-id[contrib-id-type=orcid]")
            out.append(_author(first_text(a, "surname"), " ".join(texts(a, "given-names")), ";".join(texts(a, "email")), orcid, places))
        return out
    for a in find(root, "contrib-group contrib[contrib-type=author]"):
        if first(a, "string-name") is None and first(a, "surname") is not None:
            surname, given = first_text(a, "surname"), " ".join(texts(a, "given-names"))
        else:
            surname, given = _split_name(first_text(a, "string-name"))
        refs = [x.get("rid") for x in find(a, "xref[ref-type=aff]")]
        places = [{"": first_text(affiliations[r], "institution")} for r in refs if r in affiliations]
        out.append(_author(surname, given, first_text(a, "email"), first_text(a, "idno[type=ORCID]"), places))
    return out


def jats_paragraphs(root: ET.Element, apa: bool) -> list[Paragraph]:
    out = _abstract(root)
    for k, sec in enumerate(find(root, "body sec"), 1):
        title = first(sec, "title")
        header = text(title) if title is not None else ""
        out += _block(header if header and header != "-" else f"[div-{k:02d}]", texts(sec, "p"), k)
    if not apa:
        return out
    for note in find(root, "fn-group fn"):
        bodies = texts(note, "p") or [""]
        out += [paragraph(note.get("id"), x, number(first_text(note, "label")), k, "foot") for k, x in enumerate(bodies, 1)]
    for notes in find(root, "author-notes"):
        out += [paragraph("Author Notes", x, 0, None, "annex") for x in texts(notes, "p")]
    for fig in root.iter("fig"):
        title = first_text(fig, "caption title")
        out += _block(title, texts(fig, "caption p") or [title], number(first_text(fig, "label")), "fig")
    return out


def jats_xrefs(root: ET.Element) -> list[dict]:
    above, out = parents(root), []
    for ref in root.iter("xref"):
        sentence = sentence_with(above[ref], ref)
        for target in (ref.get("rid") or "").split() or [None]:
            out.append({"xref_id": target.removeprefix("#") if target else None, "type": ref.get("ref-type"), "contents": text(ref), "text": sentence})
    return _sorted_xrefs(out)


# Kinds of publications and of entries.
JATS_TYPES = {"journal": "Article", "book-chapter": "InCollection", "book": "Book"}


def jats_bib(root: ET.Element) -> list[dict]:
    out = []
    for ref in find(root, "back ref-list ref"):
        cite = first(ref, "mixed-citation")
        cite = ref if cite is None else cite
        people = find(cite, "person-group[person-group-type=author]") or find(cite, "string-name")
        names = ["; ".join(squeeze(f"{g} {s}") for g, s in zip(texts(x, "given-names") or [""], texts(x, "surname") or [""], strict=False)) for x in people]
        kind = cite.get("publication-type")
        if kind is None:
            kind = "book-chapter" if len(texts(cite, "article-title")) > 1 else "journal" if first_text(cite, "volume") else "other"
        fields = {k: first_text(cite, p) for k, p in (("title", "article-title"), ("journal", "source"), ("year", "year"), ("volume", "volume"), ("issue", "issue"), ("fpage", "fpage"), ("lpage", "lpage"))}
        out.append(
            {"xref_id": cite.get("id") or ref.get("id"), "ref": text(ref), "doi": first_text(ref, "pub-id[pub-id-type=doi]"), "bibtype": JATS_TYPES.get(kind, "Misc"), "authors": "; ".join(filter(None, names)), **fields}
        )
    return out


# ---------------------------------------------------------------- Word, plain text


def word_paragraphs(data: bytes) -> list[Paragraph]:
    """The paragraphs of a .docx file; those in a heading style are headers."""
    with zipfile.ZipFile(io.BytesIO(data)) as file:
        root, _ = parse(file.read("word/document.xml"))
        styles = {}
        if "word/styles.xml" in file.namelist():
            for style in parse(file.read("word/styles.xml"))[0].iter("style"):
                name = style.find("name")
                styles[style.get("styleId")] = name.get("val", "") if name is not None else ""
    out = []
    for p in root.iter("p"):
        body = "".join(t.text or "" if t.tag == "t" else " " for t in p.iter() if t.tag in ("t", "tab", "br"))
        style = p.find("pPr/pStyle")
        name = style.get("val", "") if style is not None else ""
        if squeeze(body):
            out.append(paragraph(None, squeeze(body), None, None, None, "heading" in styles.get(name, name).lower()))
    return out


def plain_paragraphs(data: bytes, header: int = 20) -> list[Paragraph]:
    bodies = [squeeze(x) for x in re.split(r"\r\n?|\n", data.decode("utf-8", "replace")) if x]
    return [paragraph(None, x, None, None, None, 0 < len(x) <= header) for x in bodies]


def _kind_of_xml(root: ET.Element, doctype: str) -> str:
    if "//APA//DTD" in doctype:
        return "apa"
    if "//NLM//DTD" in doctype or root.tag == "article":
        return "nlm"
    return "tei" if root.tag == "TEI" else "text"


def kind_of(name: str, data: bytes) -> str:
    """apa, nlm, tei, word or text, from the content."""
    if data[:2] == b"PK" or name.lower().endswith(".docx"):
        return "word"
    return _kind_of_xml(*parse(data)) if name.lower().endswith(".xml") else "text"


def parse_document(name: str, data: bytes) -> dict:
    """info, authors, paragraphs, bib and xrefs of one file. Raises on files that can't be read."""
    out = {"info": {}, "authors": [], "bib": [], "xrefs": []}
    if data[:2] == b"PK" or name.lower().endswith(".docx"):
        return {**out, "paragraphs": word_paragraphs(data)}
    if not name.lower().endswith(".xml"):
        return {**out, "paragraphs": plain_paragraphs(data)}
    root, doctype = parse(data)
    kind = _kind_of_xml(root, doctype)
    if kind == "text":
        return {**out, "paragraphs": plain_paragraphs(text(root).encode())}
    if kind == "tei":
        return {"info": tei_info(root), "authors": tei_authors(root), "paragraphs": tei_paragraphs(root), "bib": tei_bib(root), "xrefs": tei_xrefs(root)}
    apa = kind == "apa"
    return {"info": jats_info(root, apa), "authors": jats_authors(root, apa), "paragraphs": jats_paragraphs(root, apa), "bib": jats_bib(root), "xrefs": jats_xrefs(root)}
