"""From paragraphs to classified sentences, in windows over each document.

Paragraph tables have id, header, text, section (set for back matter, figures and notes, else null), div, p and seq.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import guard_initials, sentences
from ..schemas import TEXT_COLUMNS, text_table

#: Characters of the longest line that counts as a header in plain text.
HEADER = 20


def lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The lines of plain texts that aren't empty, as paragraphs; short ones are headers."""
    rows = docs.select(F.col(id_column).cast("string").alias("id"), F.posexplode(F.split(text_column, "\n")).alias("seq", "text"))
    rows = rows.where(F.col("text") != "").withColumn("seq", F.col("seq").cast("bigint"))
    return number_paragraphs(rows, F.length("text") <= HEADER)


def number_paragraphs(rows: DataFrame, is_header) -> DataFrame:
    """Paragraphs below their headers: header and div come from the last header, p counts from 0, the header's own number."""
    so_far = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"_header": is_header, "_n": F.row_number().over(Window.partitionBy("id").orderBy("seq"))})
    last = lambda c: F.last(F.when(F.col("_header"), F.col(c)), ignorenulls=True).over(so_far)
    rows = rows.withColumns({"div": F.nullif(F.sum(F.col("_header").cast("int")).over(so_far).cast("int"), F.lit(0)), "header": last("text"), "p": F.col("_n") - F.coalesce(last("_n"), F.lit(1))})
    return text_table(rows.drop("_header", "_n").withColumn("section", F.lit(None).cast("string")).withColumn("s", F.lit(None).cast("int")))


def split_sentences(paragraphs: DataFrame) -> DataFrame:
    """A row for each sentence; s counts them in (div, p). Links stand in angle brackets."""
    text = F.coalesce(guard_initials(F.col("text")), F.lit(""))
    others = [c for c in paragraphs.columns if c not in ("text", "s")]
    rows = paragraphs.select(*others, F.posexplode(sentences(text)).alias("_pos", "text"))
    rows = rows.withColumn("seq", F.col("seq") * 100_000 + F.col("_pos")).drop("_pos")
    rows = rows.withColumn("text", F.replace(F.replace(F.col("text"), F.lit("{{"), F.lit("<")), F.lit("}}"), F.lit(">")))
    return rows.withColumn("s", F.row_number().over(Window.partitionBy("id", "div", "p").orderBy("seq")))


def classify_sections(rows: DataFrame) -> DataFrame:
    """section for each sentence: from its header, from what stands before, or as set already."""
    header = F.lower(F.regexp_replace(F.coalesce("header", F.lit("")), r"\s", ""))
    rows = rows.withColumn("_abstract", header.contains("abstract"))
    named = (
        F.when(header.contains("result"), "results")
        .when(header.contains("discuss"), "discussion")
        .when(header.contains("method") | header.contains("material"), "method")
        .when(header.contains("intro"), "intro")
        .when(F.col("_abstract"), "abstract")
    )
    rows = rows.withColumn("section", F.coalesce("section", named))
    whole = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = F.min(F.when(F.col("section").isNotNull() & (F.col("section") != "abstract"), F.col("seq"))).over(whole)
    rows = rows.withColumn("section", F.when((F.col("seq") < start) & ~F.col("_abstract"), "intro").otherwise(F.col("section")))
    opens = (F.col("p") == 1) & (F.col("s") == 1) & F.coalesce(F.col("header").startswith("[div"), F.lit(False))
    divs = lambda word: F.collect_set(F.when(opens & F.col("text").rlike(rf"^{word}\s*\d+"), F.col("div"))).over(whole)
    rows = rows.withColumns({"_tables": divs("Table"), "_figures": divs("Figure")})
    section = F.when(F.array_contains("_tables", F.col("div")), "table").when(F.array_contains("_figures", F.col("div")), "figure").otherwise(F.col("section"))
    rows = rows.withColumn("section", section).drop("_tables", "_figures")
    # Values go down to unclassified rows, but not into or out of abstracts: these part the rows into groups. All windows share one order.
    so_far = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_group", F.sum(F.col("_abstract").cast("int")).over(so_far))
    above = F.last(F.when(~F.col("_abstract") & F.col("section").isNotNull(), F.struct("_group", "section")), ignorenulls=True).over(so_far)
    rows = rows.withColumn("_above", above)
    filled = F.when(F.col("_above._group") == F.col("_group"), F.col("_above.section"))
    rows = rows.withColumn("section", F.when(F.col("_abstract"), F.col("section")).otherwise(F.coalesce("section", filled))).drop("_above")
    return rows.drop("_abstract", "_group")


def process_full_text(paragraphs: DataFrame) -> DataFrame:
    """The full_text table of paragraphs."""
    rows = classify_sections(split_sentences(paragraphs))
    return rows.where(~F.col("text").rlike(r"\[div-\d+\]")).select(*TEXT_COLUMNS)


def read_plain_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The full_text table of plain texts."""
    return process_full_text(lines(docs, id_column, text_column))


def locate_xrefs(xrefs: DataFrame, full_text: DataFrame) -> DataFrame:
    """xrefs with the place of the first sentence in the paper that has their text."""
    first = full_text.where("text IS NOT NULL").groupBy("id", "text").agg(F.min_by(F.struct("section", "div", "p", "s"), "seq").alias("_at"))
    out = xrefs.drop("section", "div", "p", "s").join(first, ["id", "text"], "left")
    return out.select("xref_id", "type", "contents", "text", "id", "_at.section", "_at.div", "_at.p", "_at.s")
