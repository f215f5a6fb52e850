"""Exact dedup by deterministic block naming.

A text is cut into blocks of BLOCK bytes. Distinct blocks are sorted and named by their place in the order; then the names
of adjacent blocks are paired, the distinct pairs are sorted and named, and so on until each text has one name. Two texts
of as many blocks have the same name if and only if they are identical: no hash decides.

Names are places within buckets, of which there are as many as the blocks need (about 128 MB each). A hash of the block only spreads the
blocks over the buckets, so that no task sorts all of them, and finds blocks that very many rows share. These are named once and joined back; so the sort never gets a large
group of equal rows.

Cases: a null text is empty; empty texts are equal to each other. Each row is a member of its own, also where doc_id
repeats or is null: of equal texts one row stays, with the largest doc_id (null is smallest), and of several rows with
that doc_id one. The rows are written to a table with a number each before anything else, so a retry can't number them otherwise.
Other columns are not read, so their names don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of a block, and blocks that are sorted in one bucket, about.
BLOCK, BUCKET = 4096, 1 << 15


def _buckets(spark: SparkSession, rows: int) -> int:
    """How many buckets so many names are sorted in: none has more than about BUCKET of them, whatever there is in all."""
    return max(4 * common.shuffle_partitions(spark), math.ceil(rows / BUCKET))


def _named(rows: DataFrame, keys: list[str], rank, buckets: int) -> DataFrame:
    """rows with name: the place of the keys in their order within a bucket. rank: row_number if the keys are distinct, else dense_rank."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("long")
    place = rank().over(Window.partitionBy("_bucket").orderBy(*keys)).cast("long")
    return rows.withColumn("_bucket", bucket).withColumn("name", F.shiftleft(F.col("_bucket"), 40) + place).drop("_bucket")


def _blocks(docs: DataFrame) -> DataFrame:
    """A row for each block; what belongs to the whole text is in the row of its first block."""
    rows = docs.select("rid", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.col("text").cast("binary").alias("data"))
    rows = rows.withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("data") / F.lit(BLOCK))).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("data"), i * BLOCK + 1, F.lit(BLOCK)))
    rows = rows.select("rid", "n", "doc_id", "sha", F.posexplode(cut).alias("pos", "block"))
    first = F.col("pos") == 0
    return rows.select("rid", "n", "pos", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("sha")).alias("sha"), "block")


def _block_names(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(rid, n, pos, doc_id, sha, name) of all blocks, the most blocks in a text, and buckets for all of them."""
    spark = docs.sparkSession
    length = F.octet_length("text")
    total, most = docs.agg(F.sum(F.greatest(F.lit(1), F.ceil(length / F.lit(BLOCK)))), F.max(length)).first()
    most = max(1, math.ceil((most or 0) / BLOCK))
    rows = _blocks(docs)
    buckets = _buckets(spark, total or 0)
    rows = rows.withColumn("hash", F.xxhash64("block"))
    # Blocks that would fill a bucket by themselves: no more than there are buckets, a number each.
    often = max(512, (total or 0) // buckets)
    hot = common.as_table(rows.groupBy("hash").count().where(F.col("count") > often).select("hash"), "hot-blocks")
    columns = ["rid", "n", "pos", "doc_id", "sha"]
    if hot.isEmpty():
        return _named(rows, ["block"], F.dense_rank, buckets).select(*columns, "name"), most, buckets
    shared, others = rows.join(hot, "hash", "left_semi"), rows.join(hot, "hash", "left_anti")
    once = shared.select("block").distinct().select(*(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns), "block")
    named = _named(others.select(*columns, "block").unionByName(once), ["block"], F.dense_rank, buckets)
    named = common.as_table(named.withColumn("block", F.when(F.col("rid").isNull(), F.col("block"))), "block-names")
    names = named.where(F.col("rid").isNull()).select("block", "name")
    out = named.where(F.col("rid").isNotNull()).select(*columns, "name").unionByName(shared.join(names, "block").select(*columns, "name"))
    return out, most, buckets


def _pair_names(rows: DataFrame, buckets: int) -> DataFrame:
    """rows with the names of adjacent pairs instead of those of blocks; a last one without partner is paired with -1."""
    left = F.col("pos") % 2 == 0
    pairs = rows.groupBy("rid", "n", F.expr("pos div 2").cast("int").alias("at")).agg(
        F.max(F.when(left, F.col("name"))).alias("a"),
        F.coalesce(F.max(F.when(~left, F.col("name"))), F.lit(-1)).alias("b"),
        F.max(F.when(left, F.col("doc_id"))).alias("doc_id"),
        F.max(F.when(left, F.col("sha"))).alias("sha"),
    )
    names = _named(pairs.select("a", "b").distinct(), ["a", "b"], F.row_number, buckets)
    return pairs.join(names, ["a", "b"]).select("rid", "n", F.col("at").alias("pos"), "doc_id", "sha", "name")


def identities(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, sha, n, name) for each row of docs(rid, doc_id, text), a stored table: texts are identical when n and name are.

    sha is the SHA-256 of the text, carried along for reports.
    """
    rows, most, buckets = _block_names(docs)
    rows, size, done = common.as_table(rows, "names"), 1, []
    columns = ["rid", "doc_id", "sha", "n", "name"]
    while size < most:
        done.append(rows.where(F.col("n") <= size).select(columns) if size == 1 else rows.where((F.col("n") <= size) & (F.col("n") > size // 2)).select(columns))
        size *= 2
        rows = common.as_table(_pair_names(rows.where(F.col("n") > size // 2), buckets), "pairs")
    done.append(rows.select(columns))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def duplicate_rows(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, keep_id, group_size, kept, text_sha256) for each row of docs(rid, doc_id, text), a stored table without null texts."""
    ids = common.as_table(identities(docs), "identities")
    groups = ids.groupBy("n", "name").agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    # A table of its own, so that the join has a stage of its own, in which Spark can split a large group.
    groups = common.as_table(groups, "groups")
    return ids.join(groups, ["n", "name"]).select(
        "rid", "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("top.rid")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def _given(docs: DataFrame, rid: str) -> DataFrame:
    return docs.select(F.col(rid).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """duplicate_rows() for docs(doc_id, text); rid is a number of its own for each row."""
    return duplicate_rows(_given(*common.numbered(docs.select("doc_id", "text"), "rows")))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that another one replaces; all columns of docs."""
    table, rid = common.numbered(docs, "documents")
    kept = duplicate_rows(_given(table, rid)).where("kept").select(F.col("rid").alias(rid))
    return table.join(kept, rid, "left_semi").drop(rid)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(common.read(spark, sf_dir, "documents")).drop("rid")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
