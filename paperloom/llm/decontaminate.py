"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of each benchmark item: 13 consecutive words, or all words of an item that has fewer. Patterns
of one length form a matcher. A block is BLOCK words (fewer in shorter patterns); for each block, by its hash, the shift
table says how far a search may go on from a position that ends with it: the whole length where no pattern has that block.
Where a block ends patterns (shift 0), its bucket names them; those whose first words also agree by hash are compared word
for word with the text. So hashes only choose what is compared. Documents are searched in many lanes at once, numpy arrays
of positions that each move on by their own shift.

The patterns reach the tasks by broadcast, in groups of items of about GROUP bytes of text each; a larger benchmark makes more
groups, which are searched one after another: what one pass found, by numbers of rows, is stored before the next begins, so that only
one group's patterns and workers are held at a time, and documents are written once, however many passes there are. A single item is in one group whatever its length, and is collected whole. Each
document is searched whole.

Words: A-Z lower-cased, then [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. A document's word inside any occurrence of a window is hit; a
document is contaminated if it has hits and 20 * n_hit >= n_words.

Cases: null and empty texts, of documents or items, have no words; such a document is clean. Rows of the benchmark with an
equal item_id count as one item, those without item_id as one with the empty string for id. Repeated documents are judged
each. All columns of the documents pass through untouched, whatever their names. Empty tables work.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Words of a window.
WINDOW = 13
#: Words of a block.
BLOCK = 3
#: Bytes of benchmark text whose patterns are searched together, about.
GROUP = 8 << 20
#: Positions that a lane covers.
LANE = 256


class Words:
    """The words of some texts: bytes, spans, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = common.LOWER[data]
        self.starts, self.ends, self.first = common.word_spans(self.low, offsets, common.ALNUM)
        self.hashes = common.span_hashes(common.prefix_sums(self.low), self.starts, self.ends)
        self.counts = np.diff(self.first)

    def text(self, at: int, n: int) -> bytes:
        """n words from one on, with single spaces between."""
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist(), strict=True))


class Matcher:
    """Patterns of as many words each."""

    def __init__(self, length: int, texts: list[bytes], hashes: np.ndarray, items: list[list[str]]):
        """hashes: a row of word hashes for each pattern. items: the items that have it."""
        self.length, self.texts, self.items = length, texts, items
        self.block = min(BLOCK, length)
        self.bits = max(12, (8 * len(texts)).bit_length())
        blocks = np.stack([self._mixed([hashes[:, j + k] for k in range(self.block)]) for j in range(length - self.block + 1)])
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.uint8 if length < 256 else np.int64)
        for j, at in enumerate(blocks):
            np.minimum.at(self.shift, self._slot(at), length - self.block - j)
        ends = self._slot(blocks[-1])
        self.order = np.argsort(ends, kind="stable")
        self.bucket = np.searchsorted(ends[self.order], np.arange((1 << self.bits) + 1))
        self.prefix = blocks[0][self.order]
        self.suffix = blocks[-1][self.order]

    def _mixed(self, words: list[np.ndarray]) -> np.ndarray:
        out = words[0]
        for x in words[1:]:
            out = common.mix(out * np.uint64(0xD6E8FEB86659FD93) + x)
        return out

    def _slot(self, mixed: np.ndarray) -> np.ndarray:
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _block(self, hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self._mixed([hashes[last - (self.block - 1 - k)] for k in range(self.block)])

    def ends(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences: the last word of each, and which pattern it is."""
        # Lanes over the positions where an occurrence can end.
        spans = np.maximum(0, words.counts - (self.length - 1))
        lanes = -(-spans // LANE)
        lo = np.repeat(words.first[:-1] + self.length - 1, lanes) + common.ranges(np.zeros(len(lanes), np.int64), lanes) * LANE
        hi = np.minimum(lo + LANE, np.repeat(words.first[1:], lanes))
        found, at = [], lo
        while len(at):
            mixed = self._block(words.hashes, at)
            shift = self.shift[self._slot(mixed)].astype(np.int64)
            stop = shift == 0
            found.append((at[stop], mixed[stop]))
            at = at + np.maximum(shift, 1)
            go = at < hi
            at, hi = at[go], hi[go]
        last = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        if not len(last):
            return last, last
        slot = self._slot(np.concatenate([x for _, x in found]))
        counts = self.bucket[slot + 1] - self.bucket[slot]
        pattern, last = common.ranges(self.bucket[slot], counts), np.repeat(last, counts)
        same = (self.prefix[pattern] == self._block(words.hashes, last - self.length + self.block)) & (self.suffix[pattern] == self._block(words.hashes, last))
        pattern, last = self.order[pattern[same]], last[same]
        if len(pattern):
            same = np.fromiter((self.texts[p] == words.text(x - self.length + 1, self.length) for p, x in zip(pattern.tolist(), last.tolist(), strict=True)), bool, len(pattern))
            pattern, last = pattern[same], last[same]
        return last, pattern


def matchers(ids: list[str], texts: list[str | None]) -> list[Matcher]:
    """The matchers of some benchmark items, one for each length of pattern."""
    words = Words(*common.buffers(pa.array(texts, pa.large_string())))
    known: dict[int, dict[bytes, tuple[int, set[str]]]] = {}
    for k, item in enumerate(ids):
        n = min(WINDOW, int(words.counts[k]))
        for at in range(int(words.first[k]), int(words.first[k + 1]) - n + 1) if n else ():
            known.setdefault(n, {}).setdefault(words.text(at, n), (at, set()))[1].add(item)
    return [Matcher(n, list(x), words.hashes[np.array([at for at, _ in x.values()])[:, None] + np.arange(n)], [sorted(i) for _, i in x.values()]) for n, x in sorted(known.items())]


def _search(broadcast, columns: list[str]):
    """A pass over documents with one group of patterns, which keeps some of their columns."""

    def run(batches):
        groups = broadcast.value
        for batch in batches:
            for part, data, offsets in common.slices(batch):
                words = Words(data, offsets)
                rows = part.num_rows
                hit = np.zeros(len(words.hashes) + 1, np.int64)
                items: list[set[str]] = [set() for _ in range(rows)]
                for matcher in groups:
                    last, pattern = matcher.ends(words)
                    np.add.at(hit, last - matcher.length + 1, 1)
                    np.add.at(hit, last + 1, -1)
                    row = np.searchsorted(words.first, last, "right") - 1
                    for r, p in set(zip(row.tolist(), pattern.tolist(), strict=True)):
                        items[r].update(matcher.items[p])
                at = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
                bounds = np.searchsorted(at, words.first)
                places = (at - np.repeat(words.first[:-1], np.diff(bounds))).astype(np.int32)
                hits = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(places))
                yield common.with_columns(part.select(columns), n_words=pa.array(words.counts, pa.int64()), hits=hits, items=pa.array([sorted(x) for x in items], pa.list_(pa.string())))

    return run


def _searched(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with its columns named by place (but text), so that they cannot clash with those added: n_words, hits, items."""
    spark = docs.sparkSession
    docs = docs.toDF(*(c if c == "text" else f"_{k}" for k, c in enumerate(docs.columns)))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    _, size = common.text_size(items)
    groups = max(1, math.ceil(size / GROUP))
    if groups > 1:  # read once, and then by group
        items = common.as_table(items.withColumn("group", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)).cast("int")), "benchmark", partition_by="group")
    added = [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))]

    def search(rows: DataFrame, columns: list[str], group: int) -> DataFrame:
        # Only a group of about GROUP bytes is ever collected.
        mine = (items.where(F.col("group") == group) if groups > 1 else items).select("item_id", "text").orderBy("item_id", "text").collect()
        tables = spark.sparkContext.broadcast(matchers([x.item_id for x in mine], [x.text for x in mine]))
        return rows.mapInArrow(_search(tables, columns), T.StructType([*(rows.schema[c] for c in columns), *added]))

    if groups == 1:
        return search(docs, docs.columns, 0)
    rows, rid = common.numbered(docs, "documents")
    # A pass keeps rows that it found something in; the first one all, for their words.
    passes = [common.as_table(search(rows.select(rid, "text"), [rid], g).where(F.lit(g == 0) | (F.size("hits") > 0)), "searched") for g in range(groups)]
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    found = found.groupBy(rid).agg(F.first("n_words").alias("n_words"), together("hits"), together("items"))
    return rows.join(found, rid).select(*docs.columns, "n_words", "hits", "items")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(text, ...) with n_words, hits (the places of its hit words) and items (ids of the items that occur, sorted)."""
    return _searched(docs, benchmark).toDF(*docs.columns, "n_words", "hits", "items")


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The clean rows of docs."""
    clean = _searched(docs, benchmark).where(~contaminated(F.size("hits"), F.col("n_words")))
    return clean.drop("n_words", "hits", "items").toDF(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs(doc_id, text)."""
    out = contamination(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark)
    n_hit = F.size("hits").cast("long")
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS t
  FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS u(i)
  WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
spans AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS t
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i)
  WHERE len(w) >= n),
found AS (SELECT DISTINCT r, i, n, item_id FROM spans JOIN windows USING (n, t)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS u(p) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""
