"""Connected components: edges in chunks first, each by itself, then large-star and small-star rounds over what the chunks leave."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges of a chunk, which one task contracts.
CHUNK = 1 << 16


def _contract(batches):
    """(u, v): the nodes of a chunk of edges with the least node that they are connected with in it, but for those least ones."""
    up, schema = {}, None

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]  # each node on the way points further up
        return x

    for batch in batches:
        schema = batch.schema
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            if (a := top(u)) != (b := top(v)):
                up[max(a, b)] = min(a, b)
    if up:
        found = [(x, root) for x in up if (root := top(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([pair[k] for pair in found], schema.types[k]) for k in range(2)], schema=schema)


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge only, to a node that has none onwards."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("onward")), F.struct(F.col("v").alias("node"), F.lit(0).alias("onward"))))
    nodes = edges.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.onward").alias("onward"), F.count(F.lit(1)).alias("n"))
    return nodes.where("onward > 1 OR onward = 1 AND n > 1").isEmpty()


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least neighbour of each node. A table of its own: joined by broadcast while it is small, and beyond that in a
    stage of its own, in which Spark can split a node with very many edges."""
    return common.as_table(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(a, b): root is the smallest node that it is connected with.

    Edges are dealt out in chunks of CHUNK, whatever their nodes, and of each chunk a star for each of its components is left: with one
    chunk, the result. Otherwise each round rewires edges towards the smallest neighbour; the number of rounds grows with the logarithm
    of a component's size. Nodes need an order. A node without edges to others isn't in the result. Edges are written to a
    table each round.
    """
    spread = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v"))
    edges = common.as_table(spread, "edges")
    chunks = max(1, math.ceil(edges.count() / CHUNK))
    edges = common.as_table(edges.repartition(chunks).mapInArrow(_contract, edges.schema), "edges")
    while chunks > 1 and not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both).select("u", F.least("u", "m").alias("m")), "u").where(F.col("v") > F.col("u"))
        large = common.as_table(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct(), "edges")
        small = large.join(_least(large), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = common.as_table(small.where(F.col("u") != F.col("v")).distinct(), "edges")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
