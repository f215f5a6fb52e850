"""AsPredicted and ResearchBox: links in papers, and the pages they lead to."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import message
from ..operators.search import distinct_rows, expand_text, search_text
from ..schemas import Corpus, null_safe_join
from .http import Answers, Client, attach, distinct_values, frame

# The headings of both kinds of pages, in their order.
AP_SECTIONS = {
    "AP_authors": "Author(s)",
    "AP_created": "Pre-registered on",
    "AP_data": "1) Have any data been collected for this study already?",
    "AP_hypotheses": "2) What's the main question being asked or hypothesis being tested in this study?",
    "AP_key_dv": "3) Describe the key dependent variable(s) specifying how they will be measured.",
    "AP_conditions": "4) How many and which conditions will participants be assigned to?",
    "AP_analyses": "5) Specify exactly which analyses you will conduct to examine the main question/hypothesis.",
    "AP_outliers": "6) Describe exactly how outliers will be defined and handled, and your precise rule(s) for excluding observations.",
    "AP_sample_size": "7) How many observations will be collected or what will determine sample size?\nNo need to justify decision, but be precise about exactly how the number will be determined.",
    "AP_anything_else": "8) Anything else you would like to pre-register?\n(e.g., secondary analyses, variables collected for exploratory purposes, unusual analyses planned?)",
    "AP_version": "Version of AsPredicted Questions: ",
    "end": "Report a bug",
}
RB_SECTIONS = {
    "RB_target": "SUPPLEMENTARY FILES FOR",
    "RB_license": "LICENSE FOR USE",
    "RB_public": "BOX PUBLIC SINCE",
    "RB_authors": "BOX CREATORS",
    "RB_abstract": "ABSTRACT",
    "end": "$('.file_number')",
}
CAPTCHA = "CLICK after solving captcha"
BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "table", "ul", "ol", "section"}


class _Page(HTMLParser):
    """A page's text with lines as shown, and the texts of its elements by class."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.by_class: dict[str, list[str]] = {}
        self.open: list[tuple[str, str, int]] = []
        self.headings: list[str] = []
        self.skip = 0
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.parts.append("\n")
        if tag == "style":
            self.skip += 1
        if tag not in ("br", "img", "input", "meta", "link", "hr"):
            self.open.append((tag, dict(attrs).get("class") or "", len(self.parts)))

    def handle_endtag(self, tag):
        if tag == "style":
            self.skip = max(0, self.skip - 1)
        while self.open:
            name, kind, at = self.open.pop()
            body = "".join(self.parts[at:]).strip()
            if kind:
                self.by_class.setdefault(kind, []).append(body)
            if name == "i" and any(x[0] == "h3" for x in self.open):
                self.headings.append(body)
            if name == tag:
                break
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(re.sub(r"[ \t\r\n]+", " ", data))

    @property
    def text(self) -> str:
        lines = [x.strip() for x in "".join(self.parts).split("\n")]
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def between(body: str, sections: dict[str, str]) -> dict[str, str | None]:
    """What stands between each heading and the next. Line ends in headings and text count as any white space."""
    names, out = list(sections), {}
    find = lambda heading, start: re.compile(r"\s+".join(map(re.escape, heading.split()))).search(body, start)
    for name, following in zip(names, names[1:], strict=False):
        begin = find(sections[name], 0)
        end = find(sections[following], begin.end()) if begin else None
        out[name] = body[begin.end() : end.start() if end else len(body)].strip() if begin else None
    return out


def aspredicted_links(source: Corpus | DataFrame) -> DataFrame:
    """The distinct AsPredicted addresses in the text, cleaned; one that was cut at "blind.php?" is completed from the next sentence."""
    found = search_text(source, r"/aspredicted>?\s*\.org")
    cut = F.col("text").rlike(r"blind\.php\?$")
    whole = expand_text(found.where(cut), source, plus=1).select("id", "section", "div", "p", "s", F.col("expanded").alias("_whole")).distinct()
    found = null_safe_join(found, whole, ["id", "section", "div", "p", "s"], "left").withColumn("text", F.when(cut, F.coalesce("_whole", "text")).otherwise(F.col("text"))).drop("_whole")
    text = F.regexp_replace(F.regexp_replace("text", r"(?i)/aspredicted>?\s*\.org", "/aspredicted.org"), r"(?i)blind\.php\s*\?\s*x\s*=\s*", "blind.php?x=")
    links = search_text(found.withColumn("text", text), r"/aspredicted\.org[^>]+", return_="match")
    clean = F.concat(F.lit("https:/"), F.regexp_replace(F.regexp_replace("text", r"\s", ""), r"\.pdf.*", ".pdf"))
    return distinct_rows(links.withColumn("text", clean).where("text <> 'https://aspredicted.org/blind.php?'"))


def rbox_links(source: Corpus | DataFrame) -> DataFrame:
    """The distinct ResearchBox addresses in the text."""
    links = search_text(search_text(source, "researchbox"), r"/researchbox\.org[^>]+", return_="match")
    return distinct_rows(links.withColumn("text", F.concat(F.lit("https:/"), "text")))


def aspredicted_info(url: str, client: Client | None = None) -> dict:
    """The answers of a preregistration."""
    message(f"* Retrieving info from {url}...")
    got = (client or Client()).get(url)
    return _aspredicted(url, got.status, got.text())


def _aspredicted(url: str, status: int, body: str | None) -> dict:
    if status != 200:
        return {"ap_url": url, "error": "unfound"}
    page = _Page(body or "")
    if CAPTCHA in page.text:
        return {"ap_url": url, "error": "captcha"}
    return {"ap_url": url, "AP_title": page.headings[0] if page.headings else None, **between(page.text, AP_SECTIONS)}


def rbox_info(url: str, client: Client | None = None) -> dict:
    """A box's files and description. A page that sends on to another is followed."""
    message(f"* Retrieving info from {url}...")
    client = client or Client()
    got = client.get(url)
    if onward := re.search(ONWARD, got.text()):
        got = client.get(onward[1])
    return _rbox(url, got.status, got.text())


def _rbox(url: str, status: int, body: str | None) -> dict:
    if status != 200:
        return {"rb_url": url, "error": "unfound"}
    page = _Page(body or "")
    names = page.by_class.get("file_name", [])
    descriptions = [x for x in page.by_class.get("preview_link", []) if x]
    files = [{"name": n, "description": descriptions[k] if k < len(descriptions) else None} for k, n in enumerate(names)]
    return {"rb_url": url, "files": files, **between(html.unescape(page.text), RB_SECTIONS)}


ONWARD = r"window\.location\.replace\('(https://researchbox\.org/\d+)'\)"
AP_SCHEMA = "ap_url string, error string, AP_title string, " + ", ".join(f"{c} string" for c in AP_SECTIONS if c != "end")
RB_SCHEMA = "rb_url string, error string, files array<struct<name: string, description: string>>, " + ", ".join(f"{c} string" for c in RB_SECTIONS if c != "end")


def _retrieve(table: DataFrame, column: str, info, schema: str, key: str, stop, client: Client | Answers | None) -> DataFrame:
    if isinstance(client, Answers):
        urls = table.select(F.col(column).alias("url")).where("url IS NOT NULL")
        found = client.records(urls, {"ap_url": _aspredicted, "rb_url": _rbox}[key], schema)
        return attach(table, found, column, key, f".{key[:2]}")
    rows = []
    for url in distinct_values(table, column):
        rows.append(info(url, client))
        if rows[-1].get("error") in stop:
            break
    return attach(table, frame(table.sparkSession, rows, schema), column, key, f".{key[:2]}")


def aspredicted_retrieve(table: DataFrame, column: str = "ap_url", client: Client | Answers | None = None) -> DataFrame:
    """table with the preregistration of each address; stops at a captcha, unless the answers were gathered before."""
    return _retrieve(table, column, aspredicted_info, AP_SCHEMA, "ap_url", ("captcha",), client)


def rbox_retrieve(table: DataFrame, column: str = "rb_url", client: Client | Answers | None = None) -> DataFrame:
    """table with the box of each address. A page that sends on to another is followed once."""
    if isinstance(client, Answers):
        pages = client.table.withColumn("onward", F.nullif(F.regexp_extract("body", ONWARD, 1), F.lit("")))
        there = client.table.select(F.col("url").alias("onward"), F.col("status").alias("_status"), F.col("body").alias("_body"))
        sent = pages.join(there, "onward", "left")
        followed = lambda c: F.when(F.col("onward").isNull(), F.col(c)).otherwise(F.col(f"_{c}"))
        client = Answers(sent.select("url", F.coalesce(followed("status"), F.lit(404)).alias("status"), followed("body").alias("body")))
    return _retrieve(table, column, rbox_info, RB_SCHEMA, "rb_url", ("unfound",), client)


