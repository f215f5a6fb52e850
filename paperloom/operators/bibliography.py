"""Titles looked up in a bibliography: a ladder of exact matches, then near titles by blocking on rare words and edit distance.

Two titles are near if they differ in at most EDITS letters and each has at most LOST words that the other lacks, one shared at least. Then, with
all words in one order, the rarest first, the LOST + 1 first words of either have one in common (prefix filter): these are the
keys on which titles meet. A word that very many titles have is no key of a title that has rarer ones, and equal titles meet
as one, so groups stay small; no title is compared with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.stored import stored

#: Words of a title that the other may lack, and letters that may differ in all.
LOST, EDITS = 1, 3
RUNGS = ("both", "title", "near")
#: Titles that may share a word before it is counted as common.
COMMON = 32


def plain(title: Column) -> Column:
    """A title's words in small letters, with a space between."""
    return F.array_join(words(F.coalesce(title, F.lit(""))), " ")


def _keys(titles: DataFrame, counts: DataFrame, lost: int) -> DataFrame:
    """(plain, key): each one's rarest words, by counts(word, count) of common ones; the others are rarest, in one order."""
    each = titles.select("plain", F.explode(F.array_distinct(F.split("plain", " "))).alias("word")).join(counts, "word", "left")
    rarest = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "word"))), 1, lost + 1)
    return each.groupBy("plain").agg(rarest.alias("rare")).select("plain", F.explode(F.transform("rare", lambda x: x["word"])).alias("key"))


def near_titles(asked: DataFrame, works: DataFrame, lost: int = LOST, edits: int = EDITS) -> DataFrame:
    """(plain, theirs, distance) of the near titles among those of asked(plain) and works(plain). Empty titles are near to nothing."""
    left, right = (stored(t.select("plain").where("plain <> ''").distinct(), "titles") for t in (asked, works))
    # Only common words are counted: a table so small that titles need not be dealt by their words to meet it.
    counts = right.select(F.explode(F.array_distinct(F.split("plain", " "))).alias("word")).groupBy("word").count().where(F.col("count") > COMMON)
    counts = stored(counts, "words")
    pairs = _keys(left, counts, lost).join(_keys(right, counts, lost).withColumnRenamed("plain", "theirs"), "key")
    # Pairs are judged where they meet, so that only near ones go on; words are compared where the distance, worked out no further than to its bound, allows it.
    one, other = F.split("plain", " "), F.split("theirs", " ")
    words_fit = (F.size(F.array_except(one, other)) <= lost) & (F.size(F.array_except(other, one)) <= lost)
    distance = F.when(F.abs(F.length("plain") - F.length("theirs")) <= edits, F.levenshtein("plain", "theirs", edits))
    close = pairs.select("plain", "theirs", distance.alias("distance")).where("distance >= 0").where(words_fit)
    return stored(close.distinct(), "near")


def _open(tries: DataFrame, got: DataFrame, strict: bool) -> DataFrame:
    """The tries that may still change what was got(n, got): those before it, and all of an n that has got nothing unless only a work with both counts."""
    before = F.col("try") < F.col("got.try")
    if strict:
        return tries.join(got.where("got.rung = 0 AND got.several = 1"), "n").where(before).drop("got")
    return tries.join(got, "n", "left").where(F.col("got").isNull() | before).drop("got")


def look_up(asked: DataFrame, works: DataFrame, strict: bool = True, lost: int = LOST, edits: int = EDITS) -> DataFrame:
    """(n, work, match) for each of asked(n, title, source), n unique: the work that it is, and how it was found.

    works: work, title, source. The ladder: title and source as they are, but for small and capital letters (match is "both"); the title alone
    ("title"); the nearest title ("near"). What stands before a colon is tried if the whole title finds nothing. strict: only a
    single work that has both. Otherwise, of several on one rung that of the same source comes first, then the least work. Nothing found: null.
    Each rung is only asked for what the rungs above leave open.
    """
    low = lambda c: F.lower(F.col(c))
    titles = F.when(F.contains("title", F.lit(":")), F.array(F.col("title"), F.trim(F.substring_index("title", ":", 1)))).otherwise(F.array("title"))
    tries = asked.select("n", low("source").alias("source"), F.posexplode(titles).alias("try", "title")).where("title IS NOT NULL")
    tries = stored(tries.select("n", "try", "source", low("title").alias("title"), plain(F.col("title")).alias("plain")), "tries")
    works = stored(works.select("work", low("title").alias("title"), low("source").alias("source"), plain(F.col("title")).alias("plain")).where("title IS NOT NULL"), "works")
    first = lambda *by: works.groupBy(*by).agg(F.min("work").alias("work"), F.count(F.lit(1)).alias("several"))
    rung = lambda rows, k, same: rows.select("n", "try", F.lit(k).alias("rung"), F.lit(0 if same else 1).alias("other"), "work", "several")
    best = lambda rows: rows.groupBy("n").agg(F.min(F.struct("try", "rung", "other", "work", "several")).alias("got"))

    def better(got: DataFrame, rows: DataFrame, name: str) -> DataFrame:
        return stored(best(got.select("n", "got.*").unionByName(rows)), name)

    got = stored(best(rung(tries.join(first("title", "source"), ["title", "source"]), 0, True)), "both")
    left = stored(_open(tries, got, strict), "open")
    got = better(got, rung(left.join(first("title"), "title"), 1, False), "title")
    left = stored(_open(left, got, strict), "open")
    if not left.isEmpty():
        near = near_titles(left, works, lost, edits)
        nearest = stored(near.groupBy("plain").agg(F.min("distance").alias("distance")).join(near, ["plain", "distance"]).select("plain", "theirs"), "nearest")
        met = left.join(nearest, "plain")
        same = rung(met.join(first("plain", "source").withColumnRenamed("plain", "theirs"), ["theirs", "source"]), 2, True)
        got = better(got, same.unionByName(rung(met.join(first("plain").withColumnRenamed("plain", "theirs"), "theirs"), 2, False)), "near")
    if strict:
        got = got.where("got.rung = 0 AND got.several = 1")
    name = F.element_at(F.array(*map(F.lit, RUNGS)), F.col("got.rung") + 1)
    return asked.select("n").join(got.select("n", F.col("got.work").alias("work"), name.alias("match")), "n", "left")


def add_dois(bib: DataFrame, works: DataFrame, strict: bool = True) -> DataFrame:
    """bib with the DOIs of a bibliography, works(doi, title, source), for references that have a title but no DOI; an empty DOI counts as none."""
    lacking = (F.coalesce("doi", F.lit("")) == "") & (F.coalesce("title", F.lit("")) != "")
    asked = bib.where(lacking).select("title", F.col("journal").alias("source")).distinct()
    asked = stored(asked.withColumn("n", F.monotonically_increasing_id()), "asked")  # numbers stay as they are stored
    found = look_up(asked, works.where("doi <> ''").select(F.col("doi").alias("work"), "title", "source"), strict).join(asked, "n").select(F.col("title").alias("_title"), F.col("source").alias("_source"), F.col("work").alias("_doi"))
    out = bib.join(found, lacking & (F.col("title") == F.col("_title")) & F.col("journal").eqNullSafe(F.col("_source")), "left")
    return out.withColumn("doi", F.when(lacking, F.col("_doi")).otherwise(F.col("doi"))).select(*bib.columns)
