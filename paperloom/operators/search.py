"""Search by pattern, and the text around what was found.

Both prune before they gather: only groups with a hit are joined up. The hits' keys are a semi join, which Spark broadcasts
when they are few, so that a selective search of a large corpus does not shuffle its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import java_pattern, squeeze
from ..schemas import Corpus, null_safe_join, ordered_text, text_table

RETURNS = ("sentence", "paragraph", "div", "section", "match", "id")
GROUPS = {
    "paragraph": ["section", "header", "div", "p", "id"],
    "div": ["section", "header", "div", "id"],
    "section": ["section", "id"],
    "id": ["id"],
}
PLACES = ["id", "section", "div", "p", "s"]


def full_text(source: Corpus | DataFrame) -> DataFrame:
    if isinstance(source, Corpus):
        return text_table(source.full_text)
    if isinstance(source, DataFrame):
        return text_table(source)
    raise TypeError("a corpus or a text table is needed")


def distinct_rows(df: DataFrame) -> DataFrame:
    """Rows that differ in more than seq; of equal ones the first stays."""
    others = [c for c in df.columns if c != "seq"]
    return df.groupBy(*others).agg(F.min("seq").alias("seq")).select(*df.columns)


def search_text(
    source: Corpus | DataFrame,
    pattern: str = ".*",
    section: str | list[str] | None = None,
    return_: str = "sentence",
    ignore_case: bool = True,
    fixed: bool = False,
) -> DataFrame:
    """The text that matches a pattern.

    source: a corpus, or a text table, such as an earlier result. section: only these sections. return_: the sentences, each
    match in them, or the whole paragraph, div, section or document (of the sections searched) that a match is in; columns
    that have no one value there are null. fixed: the pattern is a text, case counts. Rows are distinct, except matches.
    """
    if return_ not in RETURNS:
        raise ValueError(f"return_ must be one of {', '.join(RETURNS)}")
    text = full_text(source)
    spark, columns = text.sparkSession, text.columns
    java = java_pattern(spark, pattern, ignore_case, fixed)
    if section is not None:
        text = text.where(F.col("section").isin([section] if isinstance(section, str) else list(section)))
    test = F.col("text").contains(pattern) if fixed else F.col("text").isNotNull() if pattern == ".*" else F.col("text").rlike(java)
    hits = text.where(test)
    if return_ == "match":
        return hits.withColumn("text", F.explode(F.regexp_extract_all("text", F.lit(java), F.lit(0))))
    if return_ == "sentence":
        return distinct_rows(hits.withColumn("text", squeeze(F.col("text"))))
    keys, paragraph = GROUPS[return_], GROUPS["paragraph"]
    kept = null_safe_join(text, hits.select(*keys).distinct(), keys, "left_semi")
    parts = kept.groupBy(*paragraph).agg(squeeze(ordered_text("text", "seq", " ")).alias("text"), F.min("seq").alias("seq"))
    if return_ != "paragraph":
        parts = parts.groupBy(*keys).agg(ordered_text("text", "seq", "\n\n").alias("text"), F.min("seq").alias("seq"))
    types = dict(text.dtypes)
    return parts.select(*(F.col(c) if c in parts.columns else F.lit(None).cast(types[c]).alias(c) for c in columns))


def expand_text(results: DataFrame, source: Corpus | DataFrame, expand_to: str = "sentence", plus: int = 0, minus: int = 0) -> DataFrame:
    """results with expanded: the whole sentence, paragraph, div or section that each row's place is in.

    plus and minus: so many sentences of the paragraph after and before (only with expand_to="sentence"). A row whose place is
    not found keeps its own text.
    """
    if expand_to not in ("sentence", "paragraph", "div", "section"):
        raise ValueError("expand_to must be sentence, paragraph, div or section")
    if (plus or minus) and expand_to != "sentence":
        plus = minus = 0
    results = text_table(results)
    level = {"sentence": 5, "paragraph": 4, "div": 3, "section": 2}[expand_to]
    keys = PLACES[:level]
    wanted = results.select(*keys).distinct()
    text = full_text(source).where("text IS NOT NULL").withColumn("text", squeeze(F.col("text")))
    if expand_to == "sentence":
        near = wanted.withColumn("_offset", F.explode(F.sequence(F.lit(-minus), F.lit(plus)))).withColumn("_s", F.col("s") + F.col("_offset"))
        around = near.select(*keys, "_offset", "_s")
        rows = null_safe_join(around, distinct_rows(text.select(*PLACES, "text", "seq")), {"id": "id", "section": "section", "div": "div", "p": "p", "_s": "s"}, "inner")
        order = F.struct("_offset", "seq")
        context = rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("text").alias("t")))), lambda x: x["t"]), " ").alias("expanded"))
    else:
        rows = null_safe_join(text.select(*PLACES, "text", "seq"), wanted, keys, "left_semi")
        parts = distinct_rows(rows).groupBy(*PLACES[:4]).agg(ordered_text("text", "seq", " ").alias("expanded"), F.min("seq").alias("seq"))
        context = parts.groupBy(*keys).agg(ordered_text("expanded", "seq", "\n\n").alias("expanded"))
    out = null_safe_join(results.drop("expanded"), context, keys, "left")
    return out.withColumn("expanded", F.coalesce("expanded", "text"))
