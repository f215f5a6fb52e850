"""Merkle manifest of a dataset by Pregel-style supersteps over RDDs.

Each row is a leaf, whose digest is that of its fields, each with its length in bytes in front. The leaves of a group (a source), in
ascending order of id, are the leaves of a tree of fan-in FAN; the groups' roots, in order of the groups, those of a tree over all.

Upward, a superstep sends each node's digest to its parent. A parent is complete when its children's messages have come (the shuffle ends
with that), hashes them in order and goes on; a tree is done when its only node comes alone. Downward, each parent sends its
children the path from them to the root: the siblings on each level, with the node's own place among them. Leaves get no
message of their own: the first level's parents keep what their leaves sent and hand out the paths, so that a path is sent once for
FAN leaves. A path is folded with the leaf's digest, which gives the root if neither has been tampered with.

Places of leaves come from one sort by range of all groups together, however large a group is: the driver adds up a few numbers of each
partition (rows and groups that begin in it, and rows of its last group). Texts are read once, for the leaves' digests; all else moves
digests. Every superstep's result is a table in the shared folder, so that lost executors cost no more than a step.

Cases: a null field is `-`, so that null and empty differ. A null id comes first in its group, a null group before all others. Rows of one id
are ordered by their digests, and equal rows are leaves of their own. A group of one leaf has it as its root, one group's root is
the root of all. Other columns are not read. An empty table has no leaves, nodes or root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import common

#: Children of a node.
FAN = 16
#: Rows of a task that has leaves or messages.
TASK_ROWS = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

LEAF = "tree long, at long, digest binary, doc_id long, tampered binary"
PARENT = "tree long, at long, children array<binary>, doc_ids array<long>, tampered array<binary>"
NODE = "tree long, at long, digest binary"
PATH = "tree long, at long, slots array<int>, siblings array<binary>"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest_of(children: Iterable[bytes]) -> bytes:
    """The digest of a node: of its children's, as hexadecimal text, in order."""
    return hashlib.sha256(b"".join(x.hex().encode() for x in children)).digest()


def fold(leaf: bytes, slots: Iterable[int], siblings: Iterable[bytes]) -> bytes:
    """The root that a leaf and its path give. siblings: those of each level after each other, 32 bytes each; slots: the node's own place among them."""
    for slot, others in zip(slots, siblings, strict=True):
        each = [others[k : k + 32] for k in range(0, len(others), 32)]
        leaf = digest_of([*each[:slot], leaf, *each[slot:]])
    return leaf


def proof(siblings: Iterable[bytes]) -> str:
    """The digest of a path's siblings, level by level."""
    return hashlib.sha256(b"".join(siblings).hex().encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of fields, each `-` if null, else its bytes in UTF-8, a colon and its value."""
    text = [x.cast("string") for x in fields]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in text)).cast("binary"), 256))


# ---------------------------------------------------------------- leaves and their places


def _summary(k: int, rows: Iterator) -> Iterator[tuple]:
    """(partition, its first and last group, groups that begin in it after its first, rows of the last group)."""
    begun, first, last, run = 0, None, None, 0
    for row in rows:
        key = (row.source,)
        if last is None:
            first = last = key
        elif key != last:
            begun, last, run = begun + 1, key, 0
        run += 1
    if last is not None:
        yield k, first, last, begun, run


def placed(leaves: DataFrame) -> DataFrame:
    """LEAF of leaves(source, doc_id, digest, tampered): the number of each leaf's tree, in order of sources, and its place there."""
    spark = leaves.sparkSession
    tasks = max(common.shuffle_partitions(spark), leaves.count() // TASK_ROWS)
    # Rows that agree in all of these are interchangeable. Spark orders strings by their bytes in UTF-8.
    keys = [F.asc_nulls_first(c) for c in ("source", "doc_id", "digest", "tampered")]
    ordered = leaves.repartitionByRange(int(tasks), *keys).sortWithinPartitions(*keys).rdd
    starts, tree, at, before = {}, -1, 0, None
    for k, first, last, begun, run in sorted(ordered.mapPartitionsWithIndex(_summary).collect()):
        if first != before:
            tree, at = tree + 1, 0
        starts[k] = tree, at
        tree, at, before = tree + begun, at + run if not begun else run, last

    def number(k: int, rows: Iterator) -> Iterator[Row]:
        tree, at = starts.get(k, (0, 0))
        last = None
        for row in rows:
            if last is not None and (row.source,) != last:
                tree, at = tree + 1, 0
            last = (row.source,)
            yield tree, at, row.digest, row.doc_id, row.tampered
            at += 1

    return common.as_table(spark.createDataFrame(ordered.mapPartitionsWithIndex(number), LEAF), "leaves")


# ---------------------------------------------------------------- supersteps


def _parts(rdd: RDD) -> int:
    return max(1, rdd.getNumPartitions())


def _messages(rows: Iterator) -> Iterator[tuple]:
    """What the nodes of a partition send up, one message for consecutive nodes with one parent."""
    key, sent = None, []
    for row in rows:
        parent = row.tree, row.at // FAN
        if parent != key:
            if sent:
                yield key, sent
            key, sent = parent, []
        sent.append((row.at % FAN, *row[2:]))
    if sent:
        yield key, sent


def _parent(message: tuple) -> tuple:
    """A parent, from all that its children sent: FAN rows at most."""
    (tree, at), sent = message
    rows = sorted((x for part in sent for x in part), key=lambda x: x[0])
    columns = [list(x) for x in zip(*rows, strict=True)][1:]
    return tree, at, columns[0], *(columns[1:] or (None, None))


def up(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The parents of each level, from the one above the leaves, and the trees' roots (tree, at: the level of the highest parent, digest).

    nodes: LEAF, or NODE.
    """
    spark, levels, done = nodes.sparkSession, [], None
    while not nodes.isEmpty():
        rdd = nodes.rdd
        parents = rdd.mapPartitions(_messages).groupByKey(_parts(rdd)).map(_parent)
        parents = common.as_table(spark.createDataFrame(parents, PARENT), f"level-{len(levels) + 1}")
        alone = (F.col("at") == 0) & (F.size("children") == 1)
        roots = parents.where(alone).select("tree", F.lit(len(levels)).cast("long").alias("at"), F.col("children")[0].alias("digest"))
        done = roots if done is None else done.unionByName(roots)
        # A leaf that is a tree by itself stays in the first level, to be told its path.
        levels.append(parents if not levels else parents.where(~alone))
        above = parents.where(~alone).select("tree", "at", "children").rdd.map(lambda r: (r.tree, r.at, digest_of(r.children)))
        nodes = common.as_table(spark.createDataFrame(above, NODE), "nodes")
    return levels, done if done is not None else spark.createDataFrame([], NODE)


def _down(parent, path: tuple, skip: bool) -> Iterator[tuple]:
    """Each child's place, and the path from it to the root."""
    slots, siblings = path
    for k, _ in enumerate(parent.children):
        if skip:
            yield k, slots, siblings
        else:
            yield k, [k, *slots], [b"".join(parent.children[:k] + parent.children[k + 1 :]), *siblings]


def down(levels: list[DataFrame], starts: DataFrame) -> Iterator[tuple[int, RDD]]:
    """From the highest level, (level, RDD of (parent, path to the root)). starts: PATH of each tree's root, at: the level of its highest parent, 0 for a leaf."""
    sent = None
    for k in range(len(levels), 0, -1):
        begin = starts.where((F.col("at") == k) if k > 1 else (F.col("at") <= 1)).rdd.map(lambda r: ((r.tree, 0), (r.slots, r.siblings)))
        messages = begin if sent is None else begin.union(sent)
        level = levels[k - 1].rdd.map(lambda r: ((r.tree, r.at), r))
        met = level.join(messages, max(_parts(level), 1)).values()
        if k > 1:
            rows = met.flatMap(lambda x: [(x[0].tree, x[0].at * FAN + c, slots, siblings) for c, slots, siblings in _down(x[0], x[1], False)])
            sent = common.as_table(starts.sparkSession.createDataFrame(rows, PATH), f"paths-{k - 1}").rdd.map(lambda r: ((r.tree, r.at), (r.slots, r.siblings)))
        yield k, met


class Manifest:
    """The trees of a dataset.

    leaves(source, doc_id, digest, tampered), where tampered is the digest to verify in place of the leaf's, if not null.
    """

    def __init__(self, leaves: DataFrame):
        self.spark = leaves.sparkSession
        self.leaves = placed(leaves)
        self.levels, self.subroots = up(self.leaves)
        self.top_levels, roots = up(self.subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), "digest"))
        # Of the one tree over all groups.
        found = roots.first()
        self.root, self.top = (bytes(found.digest), found.at) if found else (None, 0)

    def nodes(self) -> DataFrame:
        """(level, tree, at, digest): all nodes, leaves at level 0; level -1 downwards: the tree over all groups."""
        own = lambda d, level: d.select(F.lit(level).alias("level"), "tree", F.explode(F.transform("children", lambda x, k: F.struct((F.col("at") * FAN + k).alias("at"), x.alias("digest")))).alias("x")).select("level", "tree", "x.*")
        tables = [own(d, k) for k, d in enumerate(self.levels)] + [own(d, -1 - k) for k, d in enumerate(self.top_levels)]
        out = tables[0] if tables else self.spark.createDataFrame([], "level int, tree long, at long, digest binary")
        for more in tables[1:]:
            out = out.unionByName(more)
        return out

    def paths(self) -> DataFrame:
        """PATH of each group's root to the root of all, at: the level of its highest parent."""
        start = self.spark.createDataFrame([(0, self.top, [], [])], PATH)
        out = None
        for k, met in down(self.top_levels, start):
            if k == 1:
                alone = self.top == 0
                out = met.flatMap(lambda x: [(x[0].tree, x[0].at * FAN + c, slots, siblings) for c, slots, siblings in _down(x[0], x[1], alone)])
        paths = common.as_table(self.spark.createDataFrame(out, PATH), "top-paths")
        return paths.select(F.col("at").alias("tree"), "slots", "siblings").join(self.subroots.select("tree", "at", "digest"), "tree")

    def proofs(self) -> DataFrame:
        """PROOFS of each leaf."""
        if self.root is None:
            return self.spark.createDataFrame([], PROOFS)
        tops = common.as_table(self.paths(), "starts")
        # The group's root travels with the paths, as a last entry that is taken off again.
        starts = tops.select("tree", "at", F.concat("slots", F.array(F.lit(-1))).alias("slots"), F.concat("siblings", F.array("digest")).alias("siblings"))
        single = self.spark.sparkContext.broadcast(self.root)

        def verify(met: tuple) -> Iterator[tuple]:
            parent, path = met
            root = single.value
            alone = parent.at == 0 and len(parent.children) == 1
            for k, slots, siblings in _down(parent, path, alone):
                subroot, slots, siblings = bytes(siblings[-1]), slots[:-1], [bytes(x) for x in siblings[:-1]]
                leaf, tampered = bytes(parent.children[k]), parent.tampered[k]
                folded = fold(leaf if tampered is None else bytes(tampered), slots, siblings)
                yield parent.doc_ids[k], leaf.hex(), subroot.hex(), root.hex(), proof(siblings), folded.hex(), folded == root

        for k, met in down(self.levels, starts):
            if k == 1:
                return self.spark.createDataFrame(met.flatMap(verify), PROOFS)
        raise AssertionError("a tree has levels")


def leaves(docs: DataFrame, tampered: Column | None = None, text: Column | None = None) -> DataFrame:
    """(source, doc_id, digest, tampered) of docs. Where tampered is true, a leaf is verified with text in place of its own."""
    fields = [F.col(c) for c in FIELDS]
    other = F.lit(None).cast("binary") if tampered is None else F.when(tampered, leaf_digest([*fields[:-1], text]))
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(fields).alias("digest"), other.alias("tampered"))
    return common.as_table(rows, "leaf-digests")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return Manifest(leaves(docs, common.crc_remainder("doc_id", 5) == 0, F.translate("text", UPPER, LOWER))).proofs()


def _sql() -> str:
    def digest(text: str) -> str:
        value = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
        return "sha256(" + " || ".join(value(x) for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"

    def crc(x: str) -> str:
        """CRC-32 of short ASCII text: bit by bit, folded over bytes."""
        step = "list_reduce(range(0, 9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, {0})"
        return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda y: ascii(y)::BIGINT)), lambda c, y: {step.format('xor(c, y)')}), 4294967295::BIGINT)"

    return f"""
WITH RECURSIVE leaf AS (
  SELECT row_number() OVER () AS r, doc_id, source, {digest("text")} AS leaf,
         CASE WHEN {crc("coalesce(doc_id::VARCHAR, '')")} % 5 = 0 THEN {digest(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {digest("text")} END AS shown
  FROM documents),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, shown) - 1 AS place FROM leaf),
node AS (
  SELECT 0 AS level, tree, place, leaf AS digest FROM placed
  UNION ALL
  SELECT level + 1, tree, place // {FAN}, sha256(string_agg(digest, '' ORDER BY place)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM node) WHERE n > 1 GROUP BY level, tree, place // {FAN}),
subroot AS (SELECT tree, arg_max(digest, level) AS subroot, max(level) AS top FROM node GROUP BY tree),
high AS (
  SELECT 0 AS level, tree AS place, subroot AS digest FROM subroot
  UNION ALL
  SELECT level + 1, place // {FAN}, sha256(string_agg(digest, '' ORDER BY place)) FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY level, place // {FAN}),
root AS (SELECT arg_max(digest, level) AS root, max(level) AS top FROM high),
steps AS (
  SELECT p.r, n.level AS step, n.place < p.place >> (4 * n.level) AS before, n.place > p.place >> (4 * n.level) AS after, n.place, n.digest
  FROM placed p JOIN subroot s USING (tree) JOIN node n ON n.tree = p.tree AND n.level < s.top AND n.place // {FAN} = p.place >> (4 * n.level + 4)
  UNION ALL
  SELECT p.r, s.top + n.level, n.place < p.tree >> (4 * n.level), n.place > p.tree >> (4 * n.level), n.place, n.digest
  FROM placed p JOIN subroot s USING (tree) CROSS JOIN root JOIN high n ON n.level < root.top AND n.place // {FAN} = p.tree >> (4 * n.level + 4)),
level AS (
  SELECT r, step, coalesce(string_agg(digest, '' ORDER BY place) FILTER (before), '') AS before, coalesce(string_agg(digest, '' ORDER BY place) FILTER (after), '') AS after FROM steps GROUP BY r, step),
proof AS (SELECT r, string_agg(before || after, '' ORDER BY step) AS siblings FROM level GROUP BY r),
folds AS (
  SELECT r, 0 AS step, shown AS digest FROM placed
  UNION ALL
  SELECT f.r, f.step + 1, sha256(before || digest || after) FROM folds f JOIN level l ON l.r = f.r AND l.step = f.step),
folded AS (SELECT r, arg_max(digest, step) AS folded FROM folds GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM placed JOIN subroot USING (tree) CROSS JOIN root JOIN folded USING (r) LEFT JOIN proof USING (r)
"""


SQL = _sql()
