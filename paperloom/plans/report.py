"""Reports in Markdown. Tables are cut to a number of rows before anything is collected."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import Corpus
from ..sources.text_files import write_files
from .modules import ModuleResult, module_find, module_run

DEFAULT = ("exact_p", "marginal", "effect_size", "statcheck", "osf_check", "retractionwatch", "ref_consistency")
# What the traffic lights mean.
LEGEND = {
    "green": ("🟢", "no problems detected"),
    "yellow": ("🟡", "something to check"),
    "red": ("🔴", "possible problems detected"),
    "info": ("🔵", "informational only"),
    "na": ("⚪️", "not applicable"),
    "fail": ("⚫️", "check failed"),
}


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """Rows as a Markdown table; null is empty."""
    cell = lambda v: "" if v is None else re.sub(r"\s*\n\s*", " ", str(v)).replace("|", "\\|")
    line = lambda values: "| " + " | ".join(values) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *(line([cell(r[c]) for c in columns]) for r in rows)])


def _table(df: DataFrame, max_rows: int, trunc_cell: int | None) -> str:
    """At most so many rows, without empty columns, the header, the place in the document, and a single id."""
    columns = [c for c in df.columns if c not in ("header", "seq")]
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(columns)), F.count_distinct("id").alias("_ids") if "id" in columns else F.lit(0).alias("_ids")).first()
    columns = [c for k, c in enumerate(columns) if counts[f"c{k}"] and not (c == "id" and counts["_ids"] < 2)]
    if not counts["_n"] or not columns:
        return ""
    rows = [r.asDict() for r in df.select(*(F.col(f"`{c}`") for c in columns)).limit(max_rows).collect()]
    if trunc_cell:
        rows = [{k: v[: trunc_cell - 3] + "..." if isinstance(v, str) and len(v) > trunc_cell else v for k, v in r.items()} for r in rows]
    return f"{markdown_table(rows, columns)}\n\nShowing {len(rows)} of {counts['_n']} rows"


def module_report(result: ModuleResult, header: int | str | None = 2, max_rows: int = 1000, trunc_cell: int | None = None) -> str:
    """One module's result: title and light, its text, and its table, or for several papers its summary."""
    if header in (None, ""):
        head = ""
    elif header == 0:
        head = f"{result.title}\n\n"
    elif isinstance(header, int):
        head = f"{'#' * header} {result.title} {{.{result.traffic_light}}}\n\n"
    else:
        head = f"{header}\n\n"
    table = result.table
    if result.summary is not None and result.summary.limit(2).count() > 1:
        table = result.summary
    body = "" if table is None else _table(table, max_rows, trunc_cell)
    return head + (f"{result.report}\n\n" if result.report else "") + body


def report(corpus: Corpus, modules: tuple[str, ...] = DEFAULT, output_file: str | None = None, options: dict[str, dict] | None = None) -> str:
    """Runs modules on one paper and writes a Markdown (Quarto) file, whose path is returned. A module that fails is reported as such."""
    first = corpus.info.limit(2).collect()
    if len(first) != 1:
        raise ValueError("a report is about one paper")
    for name in modules:
        module_find(name)
    results = []
    for name in modules:
        try:
            results.append(module_run(corpus, name, **(options or {}).get(name, {})))
        except Exception as e:  # one check's failure is part of the report
            results.append(ModuleResult(name, name, None, str(e), "fail", corpus.ids(), corpus))
    row = first[0].asDict()
    style = "\n".join(f"  h2.{k}::before {{ content: '{v[0]} '; }}" for k, v in LEGEND.items())
    legend = "\n".join(f"{v[0]} {v[1]};<br>" for v in LEGEND.values())
    head = f'---\ntitle: Report\nsubtitle: "{row.get("title") or ""}"\ndate: {date.today()}\nformat:\n  html:\n    toc: true\n---\n\n<style>\n{style}\n</style>\n\n::: {{.column-margin}}\n{legend}\n:::\n\n'
    body = re.sub(r"\n{3,}", "\n\n", "\n\n".join(module_report(r) for r in results))
    path = output_file or f"{str(row['id']).replace('/', '_')}_report.qmd"
    with open(path, "w", encoding="utf-8") as file:
        file.write(head + body)
    return path


# ---------------------------------------------------------------- a report for each paper


def _cell(c: str) -> Column:
    text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return F.replace(F.regexp_replace(text, r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))


def _line(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _section(ids: DataFrame, result: ModuleResult, columns: tuple[str, ...], max_rows: int) -> DataFrame:
    """(id, section): what a module found in each paper, with at most so many rows, in the order of the text."""
    head = F.lit(f"## {result.title}\n\n")
    nothing = F.concat(head, F.lit("Nothing found."))
    if result.table is None or "id" not in result.table.columns:
        return ids.withColumn("section", nothing)
    shown = [c for c in columns if c in result.table.columns]
    order = [c for c in ("seq",) if c in result.table.columns]
    rows = result.table.select("id", *order, _line([_cell(c) for c in shown]).alias("line"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(*order, "line"))
    first = rows.withColumn("place", place).where(F.col("place") <= max_rows).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    frame = "\n".join(("| " + " | ".join(x) + " |") for x in (shown, ["---"] * len(shown)))
    body = F.concat(head, F.lit("Showing "), F.size("lines").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(f" rows\n\n{frame}\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return ids.join(counts.join(first, "id"), "id", "left").select("id", F.when(F.col("n").isNull(), nothing).otherwise(body).alias("section"))


def paper_reports(corpus: Corpus, modules: tuple[str, ...] = DEFAULT, columns: tuple[str, ...] = ("text", "section", "div", "p", "s"), max_rows: int = 20, options: dict[str, dict] | None = None) -> DataFrame:
    """(id, report): a Markdown report for each paper of a corpus, a section for each module. The texts are put together in aggregates, none on the driver.

    A module that fails is reported as such in every paper. The number of rows shown is bounded, so the longest report is.
    """
    for name in modules:
        module_find(name)
    ids, sections = corpus.ids(), None
    for k, name in enumerate(modules):
        try:
            section = _section(ids, module_run(corpus, name, **(options or {}).get(name, {})), columns, max_rows)
        except RuntimeError as e:  # one check's failure is part of the reports
            section = ids.withColumn("section", F.lit(f"## {module_find(name).title}\n\nThis check failed: {e}"))
        section = section.withColumn("k", F.lit(k))
        sections = section if sections is None else sections.unionByName(section)
    titles = corpus.info.groupBy("id").agg((F.min("title") if "title" in corpus.info.columns else F.lit(None).cast("string")).alias("title"))
    whole = sections.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "section"))), lambda x: x["section"]), "\n\n").alias("body"))
    head = F.concat(F.lit("# "), F.coalesce(F.nullif("title", F.lit("")), "id"), F.lit("\n\n"))
    return whole.join(titles, "id").select("id", F.concat(head, "body", F.lit("\n")).alias("report"))


def write_reports(corpus: Corpus, folder: str, modules: tuple[str, ...] = DEFAULT, **more) -> DataFrame:
    """Writes each paper's report to a file by its id (a / in it makes a folder), in tasks, and returns (name, bytes)."""
    reports = paper_reports(corpus, modules, **more)
    return write_files(reports.select(F.concat("id", F.lit("_report.md")).alias("name"), F.col("report").alias("content")), folder)
