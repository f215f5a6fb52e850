"""Trees in a table of children and parents: all that lies below some roots, and the way to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored


def descendants(edges: DataFrame, roots: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(id, root, parent, depth, path) of the nodes that can be reached, a row for each root that reaches one.

    edges: id, parent, both texts or numbers; a node without parent may have a row with null or none. roots: id; if not given, the
    nodes without parent and the parents that are no node. path: the ids from the root to the node. most: the depth at which to stop.

    Each round joins only the nodes that the last one reached with the edges, which are stored by parent once; what a root has
    reached before is dropped (an anti join), so cycles end, and a node with two ways from a root has the shortest, the first by its parent
    among those. Rounds are stored, as each is read by all later ones; there are as many as the tree is deep.
    """
    edges = stored(edges.select("id", "parent").where("id IS NOT NULL AND parent IS NOT NULL").distinct().repartition("parent"), "edges")
    if roots is None:
        roots = edges.select(F.col("parent").alias("id")).distinct().join(edges.select("id"), "id", "left_anti")
    start = roots.select("id").where("id IS NOT NULL").distinct()
    kind = edges.schema["id"].dataType
    frontier = stored(start.select("id", F.col("id").alias("root"), F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("depth"), F.array("id").alias("path")), "nodes")
    rounds = [frontier]
    reached = frontier.select("root", "id")
    while (most is None or len(rounds) <= most) and not frontier.isEmpty():
        ways = frontier.select("root", F.col("id").alias("parent"), "depth", "path").join(edges, "parent")
        new = ways.join(reached, ["root", "id"], "left_anti").groupBy("root", "id").agg(F.min_by(F.struct("parent", "depth", "path"), "parent").alias("way"))
        frontier = stored(new.select("id", "root", F.col("way.parent").alias("parent"), (F.col("way.depth") + 1).alias("depth"), F.concat("way.path", F.array("id")).alias("path")), "nodes")
        rounds.append(frontier)
        reached = reached.unionByName(frontier.select("root", "id"))
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def totals(tree: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """(id, n, total): how many nodes lie at or below each one of a tree of descendants(), and the sum of their values. nodes: id, value."""
    above = tree.select(F.explode("path").alias("above"), "id", "root").join(nodes.select("id", value), "id", "left")
    return above.groupBy("root", F.col("above").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
