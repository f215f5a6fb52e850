"""N-gram Jaccard join by signature trees.

A document's set has its distinct shingles of five words. Documents of equal words are one class, and classes link when their
Jaccard similarity is 0.8 or more. Three steps, each of which keeps every link:

1. Which sets can link at all. If two sets are that similar, then the first n - ceil(0.8 n) + 1 shingles of each, in any
   order common to all sets, have a shingle in common. The order here is rarest first. So a set whose first shingles
   occur nowhere else has no partner; with most documents it ends here. How often a shingle occurs is counted over all
   documents: each chunk of documents sends the hashes of its distinct shingles, packed, to the task of their hash range and
   gets the logarithms of their counts back.
2. Families: the sets with a first shingle in common, transitively (connected components over a star of edges for each
   shingle, no pairs). All links lie inside families.
3. In each family a signature tree: sets are leaves, and a node holds the OR of its sets' token bitmaps, their range of
   sizes and their fewest bits. The sets of a family, by size and least hash, are cut into parts of FAMILY sets or BYTES bytes
   by their places in this order, whatever the number of tasks, each a subtree that one task holds; the nodes above are rows of a
   table. A dual traversal compares nodes with nodes, above the parts by joins and below them in tasks: it leaves a pair of nodes if no sets of such sizes are similar enough, if the bitmaps
   allow too small an overlap, or if all their sets are connected already; pairs of leaves are compared exactly. Texts are sent
   only for the pairs of parts that are left. Near parts come first, so that what they connect need not be compared again.

Components of the links found, with the smallest doc_id in each, are the result.

Hashes choose what is compared, and decide nothing: a document's shingles are told apart by their words (two with one hash count
as two, and the common order above is then one of hashes first), and sets that are compared have names for their shingles that are equal
only if the words are. Classes go by a cryptographic digest of all words.

Cases: null and empty texts, and texts without words, have no shingles and link with nothing. A text of one to four words
has one shingle. Rows are members of their own, also where doc_id repeats or is null (a null is never the smallest, unless
all are). Other columns are not read. An empty table gives an empty result. The rows are written to a table with a number each before
anything else, so a retry can't number them otherwise. One text is always in one task, whatever its length.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components

#: Words of a shingle.
WORDS = 5
#: Similarity from which documents link, in percent.
PERCENT = 80
#: Bytes of text in a chunk, about.
CHUNK = 8 << 20
#: Sets, and bytes of their words, of a part of a family, which one task compares with each other or with another part.
FAMILY, BYTES = 1024, 4 << 20
#: Children of a tree node: below a part, and above.
FANOUT, WIDE = 8, 32
#: Bits of a part's bitmap.
BITS = 1 << 14


# ---------------------------------------------------------------- shingles


def shingles(data: np.ndarray, offsets: np.ndarray, hash_bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first word) of the shingles of some texts, and numbers that name all words. hash_bits: how many are kept."""
    ids, hashes, first = common.named_words(common.LOWER[data], offsets, common.NONSPACE)
    words = hashes[ids]
    count = np.diff(first)
    of_doc = np.where(count >= WORDS, count - WORDS + 1, 0)
    at = common.ranges(first[:-1], of_doc)
    token = common.fold(words, WORDS)[at]
    doc = np.repeat(np.arange(len(count)), of_doc)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        whole = np.array([common.fold(words[first[d] : first[d + 1]], int(count[d]))[0] ^ np.uint64(int(count[d])) for d in short], np.uint64)
        token, doc, at = np.concatenate([token, common.mix(whole)]), np.concatenate([doc, short]), np.concatenate([at, first[short]])
    return token & np.uint64((1 << 64) - (1 << 64 - hash_bits)), doc, at, ids


def pairs_of_table(table: pa.Table, hash_bits: int = 64) -> tuple[np.ndarray, np.ndarray, int]:
    """A (hash, row) pair for each distinct shingle of each row of a table with text, sorted by both, and the number of rows."""
    tokens, docs, places, names, rows, known = [], [], [], [], 0, 0
    for batch in table.to_batches():
        for part, data, offsets in common.slices(batch):
            token, doc, at, ids = shingles(data, offsets, hash_bits)
            tokens.append(token)
            docs.append(doc + rows)
            places.append(at + known)
            names.append(ids)
            rows, known = rows + part.num_rows, known + len(ids)
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), rows
    token, doc, at, name = (np.concatenate(x) for x in (tokens, docs, places, names))
    order = np.argsort(token)
    same = np.zeros(len(token) + 1, bool)
    same[1:-1] = token[order[1:]] == token[order[:-1]]
    run = np.flatnonzero(same[1:] | same[:-1])
    order[run] = order[run][np.lexsort((doc[order[run]], token[order[run]]))]
    token, doc, at = token[order], doc[order], at[order]
    twin = np.flatnonzero((token[1:] == token[:-1]) & (doc[1:] == doc[:-1]))
    words = lambda x: [name[at[x] + k] for k in range(WORDS)]
    equal = lambda: np.logical_and.reduce([a == b for a, b in zip(words(twin), words(twin + 1), strict=True)])
    if len(twin):
        if not equal().all():  # different shingles of a document have one hash: those with equal words side by side
            run = np.union1d(twin, twin + 1)
            at[run] = at[run][np.lexsort((*words(run), doc[run], token[run]))]
        keep = np.ones(len(token), bool)
        keep[twin + 1] = ~equal()
        token, doc = token[keep], doc[keep]
    return token, doc, rows


def plain_words(table: pa.Table):
    """The words of each text of a table, lower-cased, with single spaces between."""
    for batch in table.to_batches():
        for part, data, offsets in common.slices(batch):
            word = common.NONSPACE[data]
            keep = word.copy()
            keep[1:] |= word[:-1]
            heads = offsets[:-1][np.diff(offsets) > 0]
            keep[heads] = word[heads]
            body = np.where(word, common.LOWER[data], 32).astype(np.uint8)[keep]
            bounds = np.append(0, np.cumsum(keep))[offsets].tolist()
            for k in range(part.num_rows):
                yield body[bounds[k] : bounds[k + 1]].tobytes().rstrip(b" ")


def first_count(n):
    """How many of a set's n shingles, in the common order, its partners must share one of."""
    return n - -(-PERCENT * n // 100) + 1


# ---------------------------------------------------------------- how often shingles occur


def _keys(token: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct upper 32 + bits bits of sorted shingles, and where each begins."""
    key = token >> np.uint64(32 - bits)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return key[at], at


def _ranges(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash ranges (upper bits) that sorted keys fall in, and the bounds of each range's keys (one more)."""
    part = (key >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    return part[starts], np.append(starts, len(key))


def _pack(low: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as differences, byte by byte, so that a compressor finds the zeros."""
    return np.diff(low, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32)


PACKED = "chunk long, part long, shingles binary, counts binary"
LEVELS = "chunk long, part long, levels binary"


def _packer(bits: int, hash_bits: int):
    def pack(table: pa.Table) -> pa.Table:
        token, _, _ = pairs_of_table(table, hash_bits)
        key, at = _keys(token, bits)
        counts = np.minimum(np.diff(np.append(at, len(token))), 255).astype(np.uint8)
        parts, bounds = _ranges(key)
        low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        return pa.table(
            {
                "chunk": pa.array([table["chunk"][0].as_py()] * len(parts), pa.int64()),
                "part": pa.array(parts, pa.int64()),
                "shingles": pa.array([_pack(low[a:b]) for a, b in spans], pa.binary()),
                "counts": pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary()),
            }
        )

    return pack


def _levels(table: pa.Table) -> pa.Table:
    """For each shingle the logarithm of its count over all chunks, rounded up, at most 15: 0 for those that occur once."""
    lows = [_unpack(x.as_py()) for x in table["shingles"]]
    low = np.concatenate(lows)
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table["counts"]])
    order = np.argsort(low)
    sorted_ = low[order]
    new = np.ones(len(low), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    sums = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))
    level = np.empty(len(low), np.uint8)
    level[order] = np.minimum(np.ceil(np.log2(sums)), 15).astype(np.uint8)[np.cumsum(new) - 1]
    out = []
    at = 0
    for x in lows:
        one = level[at : at + len(x)]
        at += len(x)
        one = np.append(one, np.uint8(0)) if len(one) % 2 else one
        out.append((one[::2] | one[1::2] << 4).tobytes())
    return pa.table({"chunk": table["chunk"], "part": table["part"], "levels": pa.array(out, pa.binary())})


# ---------------------------------------------------------------- sets

SETS = "rid long, doc_id long, n_shingles long, live boolean, digest binary, least long, first binary, words binary"


def _setter(bits: int, hash_bits: int):
    def sets(docs: pa.Table, levels: pa.Table) -> pa.Table:
        """A row for each document; its words and first shingles that occur elsewhere, if there are any, else null."""
        token, doc, rows = pairs_of_table(docs, hash_bits)
        key, at = _keys(token, bits)
        level = np.zeros(len(key), np.uint8)
        parts, bounds = _ranges(key)
        for k, packed in zip(np.searchsorted(parts, levels["part"].to_numpy()).tolist(), levels["levels"].to_pylist(), strict=True):
            lo, hi = bounds[k], bounds[k + 1]
            both = np.frombuffer(packed, np.uint8)
            level[lo:hi] = np.stack([both & 15, both >> 4], 1).ravel()[: hi - lo]
        level = level[np.repeat(np.arange(len(key)), np.diff(np.append(at, len(token))))] if len(key) else level
        n = np.bincount(doc, minlength=rows)
        single = np.bincount(doc[level == 0], minlength=rows)
        live = (n > 0) & (first_count(n) > single)
        keep = live[doc]
        token, doc, level = token[keep], doc[keep], level[keep]
        order = np.lexsort((token, level, doc))
        token, bounds = token[order], np.searchsorted(doc[order], np.arange(rows + 1))
        digests, least, firsts, words = [None] * rows, [None] * rows, [None] * rows, [None] * rows
        for d, text in enumerate(plain_words(docs)):
            if live[d]:
                lo, hi = bounds[d], bounds[d + 1]
                words[d] = text
                digests[d] = hashlib.blake2b(text, digest_size=16).digest()
                least[d] = int(token[lo:hi].min() >> np.uint64(1))
                firsts[d] = np.unique(token[lo + single[d] : lo + first_count(hi - lo)]).tobytes()
        columns = {"n_shingles": pa.array(n, pa.int64()), "live": pa.array(live), "digest": pa.array(digests, pa.binary()), "least": pa.array(least, pa.int64())}
        return pa.table({"rid": docs["rid"], "doc_id": docs["doc_id"], **columns, "first": pa.array(firsts, pa.binary()), "words": pa.array(words, pa.binary())})

    return sets


def document_sets(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """SETS for each row of docs(rid, doc_id, text), a stored table. hash_bits: of the shingles' hashes, kept; few give the same result, slower."""
    spark = docs.sparkSession
    _, size = common.text_size(docs)
    chunks = max(common.shuffle_partitions(spark), math.ceil(size / CHUNK))
    bits = max(0, min(31, math.ceil(math.log2(max(1, size / (CHUNK / 2))))))
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("rid"), F.lit(chunks)).cast("long"))
    levels = docs.groupBy("chunk").applyInArrow(_packer(bits, hash_bits), PACKED).groupBy("part").applyInArrow(_levels, LEVELS)
    return docs.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(_setter(bits, hash_bits), SETS)


# ---------------------------------------------------------------- signature trees


def named_sets(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each text's distinct shingles, as numbers that are equal only if the words are; (text, bit) of all in a bitmap of BITS."""
    offsets = np.cumsum([0, *map(len, texts)])
    ids, hashes, first = common.named_words(np.frombuffer(b"".join(texts), np.uint8), offsets, common.NONSPACE)
    count = np.diff(first)
    of_text = np.maximum(0, count - WORDS + 1)
    at = common.ranges(first[:-1], of_text)
    name, token = ids.astype(np.int64), common.fold(hashes[ids], WORDS)[at]
    for k in range(1, WORDS):
        if len(ids) > k:
            # A run of k + 1 words is that of its first k, and its last; both have numbers.
            _, name = np.unique(name[: len(ids) - k] * (int(ids.max()) + 1) + ids[k:], return_inverse=True)
    name, text = name[at], np.repeat(np.arange(len(texts)), of_text)
    short = np.flatnonzero(count < WORDS)  # each has one of its own, as texts are distinct
    if len(short):
        tail = np.array([common.fold(hashes[ids[first[k] : first[k + 1]]], int(count[k]))[0] for k in short], np.uint64)
        name, text, token = np.concatenate([name, len(ids) + short]), np.concatenate([text, short]), np.concatenate([token, tail])
    order = np.lexsort((name, text))
    name, text, token = name[order], text[order], token[order]
    keep = np.ones(len(name), bool)
    keep[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
    name, text, token = name[keep], text[keep], token[keep]
    return np.split(name, np.searchsorted(text, np.arange(1, len(texts)))), text, (token & np.uint64(BITS - 1)).astype(np.int64)


class Tree:
    """Sets in the order given, and over them levels of nodes of FANOUT children each. Level 0 has the sets themselves."""

    def __init__(self, sets: list[np.ndarray], width: int):
        self.sets = sets
        sizes = np.array([len(x) for x in sets])
        bits = np.zeros((len(sets), width // 8), np.uint8)
        for k, x in enumerate(sets):
            at = np.unique(x & (width - 1))
            np.bitwise_or.at(bits[k], at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        bits = bits.view(np.uint64)
        some = np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, some)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, some = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(some, at)))


def _too_unlike(low_a, high_a, some_a, low_b, high_b, some_b, shared) -> np.ndarray:
    """Whether nodes with such ranges of sizes, fewest bits and bits in common have no sets that are similar enough."""
    apart = (100 * high_a < PERCENT * low_b) | (100 * high_b < PERCENT * low_a)
    # A shingle of a set falls on a bit of it, so each bit that the other side lacks stands for one that isn't shared.
    most = np.minimum(high_a - np.maximum(0, some_a - shared), high_b - np.maximum(0, some_b - shared))
    return apart | (most * (100 + PERCENT) < PERCENT * (low_a + low_b))


def _apart(a: Tree, i: int, x: int, b: Tree, j: int, y: np.ndarray) -> np.ndarray:
    """Of the nodes y of level j of b, those that have no set similar enough to any of node x of level i of a."""
    bits_a, *numbers_a = (v[x] for v in a.levels[i])
    bits_b, *numbers_b = (v[y] for v in b.levels[j])
    return _too_unlike(*numbers_a, *numbers_b, np.bitwise_count(bits_b & bits_a).sum(1, dtype=np.int64))


def candidates(a: Tree, b: Tree):
    """(x, y) for each set x of a: all sets y of b that no pair of nodes above them rules out. If b is a, only those after x."""
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, np.zeros(1, np.int64))]
    while stack:
        i, x, j, y = stack.pop()
        if i == j == 0:
            yield x, y[y > x] if a is b else y
        elif j >= i:
            j -= 1
            y = (y[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            y = y[y < len(b.levels[j][1])]
            y = y[(y + 1) * FANOUT**j > x * FANOUT**i + 1] if a is b else y
            y = y[~_apart(a, i, x, b, j, y)] if len(y) else y
            stack += [(i, x, j, y)] if len(y) else []
        else:
            for p in range(min((x + 1) * FANOUT, len(a.levels[i - 1][1])) - 1, x * FANOUT - 1, -1):
                mine = y[(y + 1) * FANOUT**j > p * FANOUT ** (i - 1) + 1] if a is b else y
                mine = mine[~_apart(a, i - 1, p, b, j, mine)] if len(mine) else mine
                stack += [(i - 1, p, j, mine)] if len(mine) else []


class Comparer:
    """Compares sets of a with many sets of b."""

    def __init__(self, a: Tree, b: Tree):
        self.a, self.sizes, self.token = a, b.levels[0][1], np.concatenate(b.sets)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.mine = np.zeros(1 + max(int(self.token.max()), max(int(x.max()) for x in a.sets)), bool)

    def links(self, x: int, y: np.ndarray) -> np.ndarray:
        """Those of the sets y that link with set x."""
        s, n = self.a.sets[x], self.sizes[y]
        self.mine[s] = True
        both = np.add.reduceat(self.mine[self.token[common.ranges(self.starts[y], n)]], np.cumsum(n) - n, dtype=np.int64)
        self.mine[s] = False
        return y[100 * both >= PERCENT * (len(s) + n - both)]


def traverse(a: Tree, b: Tree, label_a: np.ndarray, label_b: np.ndarray) -> list[tuple[int, int]]:
    """Links between sets of a and of b (which may be the same tree) that connect all that links connect.

    label_a and label_b say which sets are connected already; they are changed along.
    """
    links: list[tuple[int, int]] = []
    compare = Comparer(a, b)
    for x, y in candidates(a, b):
        while len(y := y[label_b[y] != label_a[x]]):
            found, y = compare.links(x, y[:128]), y[128:]
            for z in found.tolist():
                if label_a[x] != (old := label_b[z]):
                    links.append((x, z))
                    label_b[label_b == old] = label_a[x]
                    label_a[label_a == old] = label_a[x]
            if len(found) and (label_a == label_a[0]).all() and (label_b == label_a[0]).all():
                return links
    return links


def every_link(a: Tree, b: Tree):
    """(x, y) for each set x of a, all sets y of b that link with it. If b is a, only those after x, so that a pair comes once."""
    compare = Comparer(a, b)
    for x, y in candidates(a, b):
        found = [compare.links(x, some) for some in np.split(y, range(128, len(y), 128))] if len(y) else []
        if sum(map(len, found)):
            yield x, np.concatenate(found)


def _width(sets: list[np.ndarray]) -> int:
    return 1 << max(9, (4 * max(map(len, sets)) - 1).bit_length())


def linked_sets(sets: list[np.ndarray], cut: int | None = None, label: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect all that links connect, in a part of a family, or between the first cut sets and the others; labels of what is connected.

    label: what is connected already.
    """
    label = np.arange(len(sets)) if label is None else label
    if cut is None:
        tree = Tree(sets, _width(sets))
        links = traverse(tree, tree, label, label)
    else:
        a, b = Tree(sets[:cut], _width(sets)), Tree(sets[cut:], _width(sets))
        links = [(x, cut + y) for x, y in traverse(a, b, label[:cut], label[cut:])]
    return links, label


def counted_links(sets: list[np.ndarray], weights: np.ndarray, cut: int | None = None) -> np.ndarray:
    """How many documents each set links with in the other sets of a part, or, with cut, in those of the other part."""
    counts = np.zeros(len(sets), np.int64)
    first = Tree(sets[:cut], _width(sets))
    second, shift = (first, 0) if cut is None else (Tree(sets[cut:], _width(sets)), cut)
    for x, y in every_link(first, second):
        counts[x] += weights[y + shift].sum()
        counts[y + shift] += weights[x]
    return counts


# ---------------------------------------------------------------- families in parts


def _explode_first(batches):
    for batch in batches:
        firsts = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("first")]
        counts = np.array([len(x) for x in firsts], np.int64)
        shingle = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(shingle), batch.column("digest").take(pa.array(np.repeat(np.arange(len(counts)), counts)))], names=["shingle", "digest"])


def families(live: DataFrame) -> DataFrame:
    """(root, digest, n_shingles, least, words, documents) of each class of live sets that shares a first shingle with another."""
    firsts = live.groupBy("digest").agg(F.first("first").alias("first")).mapInArrow(_explode_first, "shingle long, digest binary")
    stars = firsts.groupBy("shingle").agg(F.min("digest").alias("center"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    # A table of its own, so that the join has a stage of its own, in which Spark can split a shingle of many sets.
    stars = common.as_table(stars.select("shingle", "center"), "stars")
    edges = firsts.join(stars, "shingle").where(F.col("digest") != F.col("center")).select(F.col("digest").alias("a"), F.col("center").alias("b")).distinct()
    roots = common.as_table(components(edges), "families").withColumnRenamed("node", "digest")
    whole = live.groupBy("digest").agg(*(F.first(c).alias(c) for c in ("n_shingles", "least", "words")), F.count(F.lit(1)).alias("documents"))
    return common.as_table(whole.join(roots, "digest"), "members")


PARTS = """root binary, part long, chunk long, whole boolean, low int, high int, some int, bits binary, digests array<binary>, words array<binary>, weights array<bigint>, labels array<bigint>,
a array<binary>, b array<binary>, links array<bigint>"""
PARTS_ARROW = pa.schema(
    [
        ("root", pa.binary()), ("part", pa.int64()), ("chunk", pa.int64()), ("whole", pa.bool_()), ("low", pa.int32()), ("high", pa.int32()), ("some", pa.int32()), ("bits", pa.binary()),
        ("digests", pa.list_(pa.binary())), ("words", pa.list_(pa.binary())), ("weights", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("a", pa.list_(pa.binary())), ("b", pa.list_(pa.binary())), ("links", pa.list_(pa.int64())),
    ]
)


def _part(root: bytes, part: int, rows: list[tuple], several: bool, count: bool) -> dict:
    """A part of a family: its node of the tree, the links in it, and its sets, if there may be other parts. rows: digest, words, documents."""
    digests, texts, weights = (list(x) for x in zip(*rows, strict=True))
    sets, text, bit = named_sets(texts)
    each = np.unique(text * BITS + bit)
    bits = np.zeros(BITS, np.uint8)
    bits[each % BITS] = 1
    sizes = [len(x) for x in sets]
    out = {"root": root, "part": part, "low": min(sizes), "high": max(sizes), "some": int(np.bincount(each // BITS).min()), "bits": np.packbits(bits, bitorder="little").tobytes()}
    out |= {"digests": digests, "words": texts, "weights": weights} if several else {"digests": digests if count else None}
    if count:
        return out | {"whole": False, "links": counted_links(sets, np.array(weights)).tolist()}
    links, label = linked_sets(sets)
    out |= {"labels": label.tolist()} if several else {}
    return out | {"whole": bool((label == label[0]).all()), "a": [digests[x] for x, _ in links], "b": [digests[y] for _, y in links]}


def _order() -> list[Column]:
    """The order of a family's sets: by size, a factor of 1.25 at a time, and by least hash, which similar sets mostly share, so that parts are alike inside."""
    return [F.floor(F.log("n_shingles") / math.log(1.25)), F.col("least"), F.col("digest")]


def family_chunks(members: DataFrame, most: int, most_bytes: int, tasks: int) -> DataFrame:
    """members with chunk: which part of its family a set is in, by its place in _order(); null for families of one part.

    A part has at most so many sets, and at most so many bytes and one set. Only sets of larger families are put in order, without their
    words: they are dealt by range, and a place is the number of sets before in the task and in earlier tasks.
    """
    size = F.octet_length("words").cast("long")
    large = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).where((F.col("n") > most) | (F.col("bytes") > most_bytes))
    large = common.as_table(large.select("root"), "large-families")
    if large.isEmpty():
        return members.withColumn("chunk", F.lit(None).cast("long"))
    light = members.select("root", "digest", "n_shingles", "least", size.alias("bytes")).join(large, "root")
    places = common.as_table(light.repartitionByRange(tasks, "root", *_order()).withColumn("task", F.spark_partition_id()), "places")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = Window.partitionBy("root").orderBy("task")
    totals = places.groupBy("root", "task").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"))
    totals = totals.select("root", "task", before(earlier, "n").alias("sets_before"), before(earlier, "size").alias("bytes_before"))
    inside = Window.partitionBy("root", "task").orderBy(*_order())
    places = places.select("root", "task", "digest", before(inside, F.lit(1)).alias("at"), before(inside, "bytes").alias("at_byte")).join(totals, ["root", "task"])
    chunk = F.expr(f"(at + sets_before) div {most} + (at_byte + bytes_before) div {most_bytes}")
    return members.join(places.select("digest", chunk.cast("long").alias("chunk")), "digest", "left")


def family_parts(members: DataFrame, count: bool = False, most: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """PARTS of families(), whatever their size and the number of tasks: a family of many sets is in many tasks."""
    most, most_bytes, spark = most or FAMILY, most_bytes or BYTES, members.sparkSession

    def run(batches):
        base, k, key, rows, made = TaskContext.get().partitionId() << 32, 0, None, [], []
        part = lambda: _part(key[0], base + k, rows, key[1] is not None, count) | {"chunk": key[1]}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("root", "chunk", "digest", "words", "documents"))
            for root, chunk, *row in zip(*columns, strict=True):
                if rows and (root, chunk) != key:
                    made.append(part())
                    rows, k = [], k + 1
                    if len(made) >= 64 or made[-1].get("words"):
                        yield pa.RecordBatch.from_pylist(made, PARTS_ARROW)
                        made = []
                key = root, chunk
                rows.append(row)
        if rows:
            made.append(part())
        if made:
            yield pa.RecordBatch.from_pylist(made, PARTS_ARROW)

    _, size = members.agg(F.count(F.lit(1)), F.sum(F.octet_length("words"))).first()
    tasks = max(common.shuffle_partitions(spark), math.ceil((size or 0) / (8 * BYTES)))
    dealt = family_chunks(members, most, most_bytes, tasks).select("root", "chunk", "digest", "words", "documents", "n_shingles", "least")
    dealt = dealt.repartition(tasks, "root", "chunk").sortWithinPartitions("root", "chunk", *_order())
    return common.as_table(dealt.mapInArrow(run, PARTS), "parts")


NODE = "root binary, k long, low int, high int, some int, bits binary"


def _node(table: pa.Table) -> pa.Table:
    """The node above some nodes."""
    bits = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table["bits"]])
    low, high, some = (f(table[c].to_numpy()) for f, c in ((np.min, "low"), (np.max, "high"), (np.min, "some")))
    return pa.table({"root": table["root"][:1], "k": table["up"][:1], "low": pa.array([low], pa.int32()), "high": pa.array([high], pa.int32()), "some": pa.array([some], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})


def _possible(batches):
    """The pairs of nodes that may have similar sets: one for each side in _apart()'s terms."""
    for batch in batches:
        low_a, high_a, some_a, low_b, high_b, some_b = (batch.column(f"{c}_{side}").to_numpy().astype(np.int64) for side in "ab" for c in ("low", "high", "some"))
        bits_a, bits_b = (common.buffers(batch.column(f"bits_{side}"))[0].copy().reshape(-1, BITS // 8).view(np.uint64) for side in "ab")
        shared = np.bitwise_count(bits_a & bits_b).sum(1, dtype=np.int64)
        keep = ~_too_unlike(low_a, high_a, some_a, low_b, high_b, some_b, shared)
        yield batch.select(["root", "left", "right"]).filter(pa.array(keep))


def part_pairs(parts: DataFrame) -> tuple[DataFrame, int] | None:
    """(left, right, gap): parts of a family, and how far apart they are in it, that may have similar sets; and the largest gap there can be.

    The dual traversal above the parts, level by level from the root. A family's parts are numbered in one task: one row for FAMILY
    sets or BYTES bytes, without the words.
    """
    several = parts.where("words IS NOT NULL").select("root", "part", "chunk", "whole", "low", "high", "some", "bits")
    several = several.withColumn("k", (F.row_number().over(Window.partitionBy("root").orderBy("chunk")) - 1).cast("long"))
    nodes = [common.as_table(several, "nodes")]
    most = last = nodes[0].agg(F.max("k")).first()[0] or 0
    if not most:
        return None
    while last >= WIDE:
        up = nodes[-1].select("root", F.expr(f"k div {WIDE}").alias("up"), "low", "high", "some", "bits").groupBy("root", "up").applyInArrow(_node, NODE)
        nodes.append(common.as_table(up, "nodes"))
        last //= WIDE
    side = lambda df, s: df.select("root", *(F.col(c).alias(f"{c}_{s}") for c in ("k", "low", "high", "some", "bits")))
    pairs = None
    for level in reversed(nodes):
        a, b = side(level, "a"), side(level, "b")
        if pairs is None:
            joined = a.join(b, "root")
        else:
            joined = pairs.join(a.withColumn("left", F.expr(f"k_a div {WIDE}")), ["root", "left"]).join(b.withColumn("right", F.expr(f"k_b div {WIDE}")), ["root", "right"])
        order = F.col("k_a") < F.col("k_b") if level is nodes[0] else F.col("k_a") <= F.col("k_b")
        joined = joined.where(order).drop("left", "right").withColumnsRenamed({"k_a": "left", "k_b": "right"})
        pairs = common.as_table(joined.mapInArrow(_possible, "root binary, left long, right long"), "node-pairs")
    name = lambda s: nodes[0].select("root", F.col("k").alias(s), F.col("part").alias(f"{s}_part"), F.col("whole").alias(f"{s}_whole"))
    pairs = pairs.join(name("left"), ["root", "left"]).join(name("right"), ["root", "right"])
    pairs = pairs.select(F.col("left_part").alias("left"), F.col("right_part").alias("right"), (F.col("right") - F.col("left")).alias("gap"), (F.col("left_whole") & F.col("right_whole")).alias("whole"))
    return common.as_table(pairs, "part-pairs"), most


def _compare(count: bool):
    def compare(table: pa.Table) -> pa.Table:
        """Two rows, the parts of a pair: their links."""
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        digests, texts = ([x for r in rows for x in r[c]] for c in ("digests", "words"))
        sets, cut = named_sets(texts)[0], len(rows[0]["digests"])
        if count:
            weights = np.array([x for r in rows for x in r["weights"]])
            return pa.table({"digest": pa.array(digests, pa.binary()), "links": pa.array(counted_links(sets, weights, cut))})
        label = np.concatenate([rows[0]["labels"], np.array(rows[1]["labels"]) + len(sets)])
        links, _ = linked_sets(sets, cut, label)
        side = lambda c: pa.array([rows[c]["part"]] * len(links), pa.int64())
        return pa.table({"left": side(0), "right": side(1), "a": pa.array([digests[x] for x, _ in links], pa.binary()), "b": pa.array([digests[y] for _, y in links], pa.binary())})

    return compare


def _compared(parts: DataFrame, pairs: DataFrame, count: bool) -> DataFrame:
    columns = ["part", "digests", "words", "weights" if count else "labels"]
    parts = parts.where("words IS NOT NULL").select(*columns)
    one = lambda side: pairs.select("left", "right").join(parts, F.col(side) == F.col("part"))
    schema = "digest binary, links long" if count else "left long, right long, a binary, b binary"
    return one("left").unionByName(one("right")).groupBy("left", "right").applyInArrow(_compare(count), schema)


# ---------------------------------------------------------------- the join


def set_links(members: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b): links between classes of families() that connect all that links connect."""
    parts = family_parts(members, most=most)
    each = F.arrays_zip("a", "b")
    links = parts.where(F.size("a") > 0).select(F.explode(each).alias("e")).select("e.a", "e.b")
    if not (found := part_pairs(parts)):
        return links
    pairs, last = found
    if pairs.count() <= common.shuffle_partitions(members.sparkSession):  # few enough to be compared at once
        return links.unionByName(common.as_table(_compared(parts, pairs, False), "links-across").select("a", "b"))
    # Pairs of near parts first, twice as far each time. Parts that are connected inside, and by now with each other, need no comparison.
    merged, edges = None, None
    for r in range(last.bit_length()):
        mine = pairs.where(F.col("gap").between(1 << r, (2 << r) - 1))
        if merged is not None:
            of = lambda side: merged.select(F.col("node").alias(side), F.col("root").alias(f"{side}_in"))  # noqa: B023, E731
            mine = mine.join(of("left"), "left", "left").join(of("right"), "right", "left")
            mine = mine.where("left_in IS NULL OR right_in IS NULL OR left_in <> right_in OR NOT whole").select("left", "right", "whole")
        new = common.as_table(_compared(parts, mine, False), "links-across")
        links = links.unionByName(new.select("a", "b"))
        if 2 << r <= last:
            more = new.select("left", "right").distinct().join(pairs.where("whole"), ["left", "right"], "left_semi").select(F.col("left").alias("a"), F.col("right").alias("b"))
            edges = more if edges is None else edges.unionByName(more)
            merged = common.as_table(components(edges), "merged-parts")
    return links


def _given(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text), stored, for docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    table, rid = common.numbered(rows, "rows")
    return table.withColumnRenamed(rid, "rid")


def link_counts(docs: DataFrame, most: int | None = None, hash_bits: int = 64) -> DataFrame:
    """(rid, doc_id, n_shingles, n_links) for each row of docs(doc_id, text): how many other rows it is similar to, all pairs counted."""
    sets = common.as_table(document_sets(_given(docs), hash_bits), "sets")
    live = sets.where("live")
    parts = family_parts(families(live), count=True, most=most)
    found = parts.select(F.explode(F.arrays_zip("digests", "links")).alias("e")).select(F.col("e.digests").alias("digest"), "e.links")
    if across := part_pairs(parts):
        found = found.unionByName(_compared(parts, across[0], True))
    found = found.groupBy("digest").agg(F.sum("links").alias("links"))
    of_set = live.groupBy("digest").agg(F.count(F.lit(1)).alias("documents")).join(found, "digest", "left")
    of_set = common.as_table(of_set.select("digest", (F.col("documents") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "link-counts")
    rows = sets.select("rid", "doc_id", "n_shingles", "live", "digest")
    linked = rows.where("live").join(of_set, "digest").select("rid", "doc_id", "n_shingles", "n_links")
    return linked.unionByName(rows.where(~F.col("live")).select("rid", "doc_id", "n_shingles", F.lit(0).cast("long").alias("n_links")))


def similar_rows(docs: DataFrame, most: int | None = None, hash_bits: int = 64) -> DataFrame:
    """(rid, doc_id, n_shingles, component_id, kept) for each row of docs(rid, doc_id, text), a stored table; kept is true for one row of a component."""
    sets = common.as_table(document_sets(docs, hash_bits), "sets")
    live = sets.where("live")
    roots = components(set_links(families(live), most)).withColumnRenamed("node", "digest")
    # Classes first, before anything is dealt by their digest; a null doc_id comes last.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("least")
    of_set = live.groupBy("digest").agg(least).join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    of_set = common.as_table(of_set, "equal-sets")
    best = common.as_table(of_set.groupBy("root").agg(F.min("least").alias("best")), "least-of-components")
    classes = of_set.join(best, "root").select("digest", F.col("best.doc_id").alias("component_id"), F.col("best.rid").alias("keep"))
    classes = common.as_table(classes, "classes")
    rows = sets.select("rid", "doc_id", "n_shingles", "live", "digest")
    linked = rows.where("live").join(classes, "digest").select("rid", "doc_id", "n_shingles", "component_id", (F.col("rid") == F.col("keep")).alias("kept"))
    alone = rows.where(~F.col("live")).select("rid", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def similar_documents(docs: DataFrame, most: int | None = None, hash_bits: int = 64) -> DataFrame:
    """similar_rows() for docs(doc_id, text); rid is a number of its own for each row."""
    return similar_rows(_given(docs), most, hash_bits)


def drop_similar(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that with the smallest doc_id; all columns of docs."""
    table, rid = common.numbered(docs, "documents")
    given = table.select(F.col(rid).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kept = similar_rows(given).where("kept").select(F.col("rid").alias(rid))
    return table.join(kept, rid, "left_semi").drop(rid)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(common.read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_jaccard_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(common.read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "n_links")


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

#: All pairs with a shingle in common, so for small tables only.
SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + {WORDS - 1}], ' ') AS t FROM d, unnest(range(1, len(w) - {WORDS - 2})) AS u(i) WHERE len(w) >= {WORDS}
  UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {WORDS - 1}),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.r < b.r GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * c >= {PERCENT} * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(r, q) AS (SELECT r, r FROM n UNION SELECT reach.r, both_ways.b FROM reach JOIN both_ways ON reach.q = both_ways.a),
least AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.q GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN least USING (r)
"""

_LINKS, _, _ = SQL.partition("reach(r, q) AS")

#: The same pairs, counted for each document.
SQL_COUNTS = f"""{_LINKS}
each AS (SELECT a AS r, count(*) AS n_links FROM both_ways GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(n_links, 0) AS n_links FROM d LEFT JOIN n USING (r) LEFT JOIN each USING (r)
"""
