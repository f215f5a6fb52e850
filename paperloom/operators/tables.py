"""Tables about papers: their info, authors and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import DOI
from ..schemas import Corpus


def _plain(df: DataFrame, name: str) -> Column:
    """A column as text; several values are joined."""
    kind = dict(df.dtypes)[name]
    return F.array_join(F.col(name).cast("array<string>"), "; ") if kind.startswith("array") else F.col(name).cast("string")


def info_table(corpus: Corpus, info: list[str] = ("filename", "title", "keywords", "doi")) -> DataFrame:
    """id and some info columns of each paper; a column that no paper has is null."""
    info = [c for c in info if c != "id"]
    df = corpus.info
    return df.select("id", *(_plain(df, c).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in info))


def author_table(corpus: Corpus) -> DataFrame:
    """A row for each author, n in the order of the paper; an author's affiliations are one text."""
    each = corpus.authors.select("id", F.posexplode("authors").alias("n", "a"))
    affiliations = F.transform("a.affiliation", lambda m: F.array_join(F.map_values(m), ", "))
    return each.select(
        "a.orcid", F.col("a.name.surname").alias("surname"), F.col("a.name.given").alias("given"), F.array_join("a.roles", "; ").alias("roles"), "a.email",
        F.array_join(affiliations, "; ").alias("affiliation"), "id", (F.col("n") + 1).alias("n"),
    )


def paper_validate(corpus: Corpus) -> DataFrame:
    """(id, valid, doi, title, abstract, bib): what is missing or unusual in each paper; bib is the number of references."""
    info = info_table(corpus, ["title", "description", "doi"]).select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("title", "description", "doi")))
    counts = corpus.bib.groupBy("id").agg(F.count(F.lit(1)).alias("bib"))
    title = F.lower("title")
    rows = info.join(counts, "id", "left").select(
        "id",
        F.when(F.col("doi") == "", "missing").when(~F.col("doi").rlike(DOI), "invalid").otherwise("").alias("doi"),
        F.when(title == "", "missing")
        .when(title.contains("commentary on"), "commentary")
        .when(title.contains("corrigendum"), "corrigendum")
        .when(title.contains("erratum"), "erratum")
        .when(title.contains("reply to"), "reply")
        .otherwise("")
        .alias("title"),
        F.when(F.col("description") == "", "missing").otherwise("").alias("abstract"),
        F.coalesce("bib", F.lit(0)).alias("bib"),
    )
    valid = (F.col("doi") == "") & (F.col("title") != "missing") & (F.col("abstract") == "") & (F.col("bib") > 0)
    return rows.select("id", valid.alias("valid"), "doi", "title", "abstract", "bib")


def fill_down(df: DataFrame, columns: list[str], partition: list[str], order: str = "seq") -> DataFrame:
    """Nulls take the last value before them."""
    from pyspark.sql import Window

    before = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in columns})


def first_of(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The first row of each group."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def keep_within(df: DataFrame, size: str, most: float, partition: list[str], tie: str) -> DataFrame:
    """The smallest items whose sizes add up to most: the largest go first until the rest fits."""
    from pyspark.sql import Window

    so_far = Window.partitionBy(*partition).orderBy(size, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_sum", F.sum(size).over(so_far)).where(F.col("_sum") <= most).drop("_sum")
