"""Token ids as a wavelet matrix per shard.

Documents in ascending order of doc_id are dealt over tasks by range. A task encodes them and cuts them into shards of
about SHARD tokens; a shard becomes a row of a Parquet file with the documents' ids and ends, the alphabet (the shard's
distinct token ids, the most frequent first) and a wavelet matrix of the tokens' places in it: a bit-plane a level, the
number of zeros in it, and the number of ones before each block of 512 bits. From it come the token at a position
(access), the number of times a token occurs before a position (rank), all its occurrences (select), and, fastest for
whole shards, all tokens. The files are compressed with zstd. Because shards are rows with a number of their own, a reader
takes the shards and planes that it needs.

Encoding keeps a table of distinct chunks, cut where the tokenizer's pattern never joins characters, so that chunks have
the same ids alone as in the text. That is checked when a tokenizer is loaded; with another pattern, texts are encoded whole.

Cases: a null or empty text has the end id only. Rows with equal doc_id are ordered by a hash of the text; a null doc_id
comes first. Other columns are not written. An empty table writes no shard.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .chunk_table import ChunkTable

#: Tokens of a shard, about; one document is never divided.
SHARD = 1 << 19
#: Bytes of text that a task turns into shards, about.
TASK = 48 << 20
#: Bytes of text that are encoded at once; more text shares more distinct chunks.
SLICE = 4 << 20
#: Bits between two counts of ones.
BLOCK = 512
SCHEMA = "part int, shard int, tokens long, doc_ids array<bigint>, ends array<bigint>, alphabet array<int>, planes array<binary>, zeros array<bigint>, ranks array<binary>"


class WaveletMatrix:
    """Bit-planes of a sequence of numbers, from the highest bit to the lowest; each level's zeros come first in the next."""

    def __init__(self, n: int, planes: list[bytes], zeros: list[int], ranks: list[bytes]):
        self.n, self.zeros = n, zeros
        self.planes = [np.frombuffer(x, np.uint8) for x in planes]
        self.ranks = [np.frombuffer(x, np.uint32) for x in ranks]

    @classmethod
    def build(cls, sequence: np.ndarray, levels: int) -> WaveletMatrix:
        planes, zeros, ranks = [], [], []
        for level in range(levels):
            bits = (sequence >> (levels - 1 - level)) & 1
            plane = np.packbits(bits.astype(np.uint8), bitorder="little")
            plane = np.concatenate([plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8)])
            ones = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1)
            bits = bits.astype(bool)
            low = sequence.compress(~bits)
            sequence = np.concatenate([low, sequence.compress(bits)])
            planes.append(plane.tobytes())
            zeros.append(len(low))
            ranks.append((np.cumsum(ones) - ones).astype(np.uint32).tobytes())
        return cls(len(sequence), planes, zeros, ranks)

    def stored(self) -> dict:
        return {"planes": [x.tobytes() for x in self.planes], "zeros": self.zeros, "ranks": [x.tobytes() for x in self.ranks]}

    def _ones(self, level: int, at: int) -> int:
        """Ones before a position of a level."""
        if at >= self.n:
            return self.n - self.zeros[level]
        block = at // BLOCK
        inside = np.unpackbits(self.planes[level][block * BLOCK // 8 : at // 8 + 1], bitorder="little")[: at - block * BLOCK]
        return int(self.ranks[level][block]) + int(inside.sum())

    def _find(self, level: int, bit: int, k: int) -> int:
        """The position of the k-th one or zero (from 0) of a level."""
        before = self.ranks[level].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, "right")) - 1
        inside = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(inside == bit)[k - before[block]])

    def access(self, at: int) -> int:
        """The number at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        out = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[at // 8] >> (at % 8) & 1)
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            out = out << 1 | bit
        return out

    def _range(self, number: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self._ones(level, lo), self._ones(level, hi)
            one = number >> (len(self.planes) - 1 - level) & 1
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if one else (lo - a, hi - b)
        return lo, hi

    def rank(self, number: int, at: int) -> int:
        """How often a number occurs before a position."""
        lo, hi = self._range(number, 0, min(at, self.n))
        return hi - lo

    def select(self, number: int, k: int) -> int:
        """The position of a number's k-th occurrence (from 0)."""
        lo, hi = self._range(number, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in reversed(range(len(self.planes))):
            one = number >> (len(self.planes) - 1 - level) & 1
            at = self._find(level, one, at - self.zeros[level] if one else at)
        return at

    def all(self) -> np.ndarray:
        """The whole sequence."""
        out = np.zeros(self.n, np.uint32 if len(self.planes) > 16 else np.uint16)
        for level in reversed(range(len(self.planes))):
            bits = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            back = np.empty_like(out)
            back[np.flatnonzero(~bits)] = out[: self.zeros[level]]
            back[np.flatnonzero(bits)] = out[self.zeros[level] :] | out.dtype.type(1 << (len(self.planes) - 1 - level))
            out = back
        return out


class Shard:
    """A shard as read from a file."""

    def __init__(self, row: dict):
        self.doc_ids, self.ends = row["doc_ids"], np.array(row["ends"], np.int64)
        self.alphabet = np.array(row["alphabet"], np.uint32)
        self.matrix = WaveletMatrix(row["tokens"], row["planes"], row["zeros"], row["ranks"])
        self._place = None

    def _code(self, token: int) -> int | None:
        if self._place is None:
            self._place = {t: k for k, t in enumerate(self.alphabet.tolist())}
        return self._place.get(token)

    def token(self, at: int) -> int:
        return int(self.alphabet[self.matrix.access(at)])

    def count(self, token: int, before: int | None = None) -> int:
        code = self._code(token)
        return 0 if code is None else self.matrix.rank(code, self.matrix.n if before is None else before)

    def occurrence(self, token: int, k: int) -> int:
        code = self._code(token)
        if code is None:
            raise IndexError(k)
        return self.matrix.select(code, k)

    def tokens(self) -> np.ndarray:
        return self.alphabet[self.matrix.all()] if self.matrix.n else np.zeros(0, np.uint32)


def shard_row(part: int, shard: int, doc_ids: list, tokens: np.ndarray, ends: np.ndarray) -> dict:
    counts = np.bincount(tokens)
    alphabet = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype(np.int32)
    code = np.zeros(len(counts), np.uint32 if len(alphabet) > 1 << 16 else np.uint16)
    code[alphabet] = np.arange(len(alphabet))
    matrix = WaveletMatrix.build(code[tokens], max(1, (len(alphabet) - 1).bit_length()))
    return {"part": part, "shard": shard, "tokens": len(tokens), "doc_ids": doc_ids, "ends": ends.tolist(), "alphabet": alphabet.tolist(), **matrix.stored()}


# ---------------------------------------------------------------- encoding


def _kinds() -> np.ndarray:
    """For each byte: 1 white space, 2 letter or digit, 4 other character that is no white space, 0 else (and above 7E)."""
    out = np.zeros(256, np.uint8)
    out[33:127] = 4
    out[[9, 10, 11, 12, 13, 32]] = 1
    out[48:58] = out[65:91] = out[97:123] = 2
    return out


KIND = _kinds()


def safe_chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of chunks that are tokenized alone as in the text, and each text's first chunk.

    A chunk starts before white space after another character, before a punctuation mark (no apostrophe) after a letter
    or digit, and before a letter or digit after a line end which is no part of a longer run of white space. Letters are
    those of ASCII and, in two bytes from C3, of Latin-1; after further characters nothing starts.
    """
    kind = KIND[data]
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    kind[latin] = 2
    start = np.zeros(len(data), bool)
    start[1:] = (kind[1:] == 1) & (kind[:-1] >= 2)
    start[1:] |= (kind[1:] == 4) & (kind[:-1] == 2) & (data[1:] != 0x27)
    start[2:] |= (kind[2:] == 2) & (data[2:] < 0x80) & (data[1:-1] == 0x0A) & (kind[:-2] >= 2)
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, offsets)


class Encoder:
    """Encodes texts with a tokenizer file, and adds an end id."""

    SEPARATOR = "<|endoftext|>"
    JOINED = 1000

    def __init__(self, tokenizer: bytes, end: int):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer.decode())
        spec = json.loads(tokenizer)
        split = spec.get("pre_tokenizer") or {}
        # safe_chunks() is for this pattern; with any other, texts are single chunks.
        self.splits = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.separator = self.tokenizer.token_to_id(self.SEPARATOR)
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[i for x, i in vocabulary.items() if x[0] == "\u0120"]] = True  # how byte-level vocabularies write a space
        self.table = ChunkTable(self._encode, end)

    def _separated(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and their counts; many are encoded as one text, with a special token between, which divides texts."""
        ids = self._ids([self.SEPARATOR.join(texts[i : i + self.JOINED]) + self.SEPARATOR for i in range(0, len(texts), self.JOINED)])
        stops = np.flatnonzero(ids == self.separator)
        return ids[ids != self.separator], np.diff(stops, prepend=-1) - 1

    def _spaced(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that all begin with their only space: each token that begins with a space begins a text."""
        ids = self._ids(["".join(texts[i : i + self.JOINED]) for i in range(0, len(texts), self.JOINED)])
        starts = np.flatnonzero(self.leads[ids])
        if len(starts) != len(texts) or len(starts) and starts[0]:
            return self._separated(texts)
        return ids, np.diff(np.append(starts, len(ids)))

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
        return np.array([i for x in own for i in x], np.int32), np.array([len(x) for x in own], np.int64)

    def _ids(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int32), *(np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))])

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [x.decode("utf-8", "replace") for x in chunks]
        # 0: a space, then up to a mark, letter or digit of ASCII without another space; 1: others; 2: those with special tokens.
        special = self.SEPARATOR.encode()
        kind = np.fromiter((0 if x[0] == 32 and 32 < x[-1] < 127 and x.count(b" ") == 1 else 1 for x in chunks), np.int8, len(chunks))
        if self.separator is None:
            kind[:] = 2
        else:
            kind[[k for k, x in enumerate(chunks) if special in x]] = 2
        counts, parts = np.zeros(len(texts), np.int64), []
        for k, encode in enumerate((self._spaced, self._separated, self._alone)):
            if len(mine := np.flatnonzero(kind == k)):
                ids, counts[mine] = encode([texts[i] for i in mine.tolist()])
                parts.append((mine, ids))
        out, before = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for mine, ids in parts:
            out[common.ranges(before[mine], counts[mine])] = ids
        return out, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, first = safe_chunks(data, offsets)
        if not self.splits:
            starts = np.unique(offsets[:-1][np.diff(offsets) > 0])
            first = np.searchsorted(starts, offsets)
        # The tokenizer finds its added tokens before anything else; texts with one are single chunks.
        raw, whole = data.tobytes(), set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                whole.add(text := int(np.searchsorted(offsets, at, "right")) - 1)
                at = raw.find(token, int(offsets[text + 1]) - len(token) + 1)
        if whole:
            keep = np.ones(len(starts), bool)
            for text in whole:
                keep[first[text] + 1 : first[text + 1]] = False
            starts = starts[keep]
            first = np.searchsorted(starts, offsets)
        return self.table.tokens(data, starts, first)


def write_shards(docs: DataFrame, tokenizer_path: str, end: int, path: str) -> DataFrame:
    """Writes the shards of docs(doc_id, text) to path, and returns them as read from there (SCHEMA)."""
    spark = docs.sparkSession
    tokenizer = spark.sparkContext.broadcast(common.vocabulary(tokenizer_path))
    _, size = common.text_size(docs)
    # No more tasks than needed, as each has to encode its distinct chunks.
    tasks = max(min(common.shuffle_partitions(spark), spark.sparkContext.defaultParallelism), math.ceil(size / TASK))

    def run(batches):
        encoder, part, shard = Encoder(tokenizer.value, end), TaskContext.get().partitionId(), 0
        doc_ids, tokens, lengths, held = [], [], [], 0

        def flush():
            row = shard_row(part, shard, doc_ids, np.concatenate(tokens), np.cumsum(np.concatenate(lengths)))
            return pa.RecordBatch.from_pylist([row], ARROW)

        for batch in batches:
            for rows, data, offsets in common.slices(batch, most=SLICE):
                ids, at = encoder.encode(data, offsets)
                names, a = rows.column("doc_id").to_pylist(), 0
                while a < len(names):
                    b = max(a + 1, int(np.searchsorted(at, at[a] + SHARD - held, "right")) - 1)
                    doc_ids += names[a:b]
                    tokens.append(ids[at[a] : at[b]])
                    lengths.append(np.diff(at[a : b + 1]))
                    held, a = held + int(at[b] - at[a]), b
                    if held >= SHARD or a < len(names):
                        yield flush()
                        doc_ids, tokens, lengths, held, shard = [], [], [], 0, shard + 1
        if held:
            yield flush()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    out = docs.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(run, SCHEMA)
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("shard", pa.int32()),
        ("tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int64())),
        ("alphabet", pa.list_(pa.int32())),
        ("planes", pa.list_(pa.binary())),
        ("zeros", pa.list_(pa.int64())),
        ("ranks", pa.list_(pa.binary())),
    ]
)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, shard, before): the tokens of all shards before each. Sums by part first, so that only these meet in one task."""
    sizes = shards.select("part", "shard", "tokens")
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("sum"))
    earlier = F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", earlier.alias("earlier"))
    return sizes.withColumn("inside", inside).join(parts, "part").select("part", "shard", (F.col("earlier") + F.col("inside")).alias("before"))


def read_documents(shards: DataFrame) -> DataFrame:
    """(part, shard, doc_id, offset, n_tokens, ids_crc32) of each document, from its shard; offset is its first token there."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                shard = Shard(row)
                raw = memoryview(shard.tokens().astype("<u4").tobytes())
                starts = np.append(0, shard.ends[:-1])
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int32()),
                        pa.array([row["shard"]] * n, pa.int32()),
                        pa.array(shard.doc_ids, pa.int64()),
                        pa.array(starts),
                        pa.array(shard.ends - starts),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), shard.ends.tolist(), strict=True)], pa.int64()),
                    ],
                    names=["part", "shard", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    return shards.mapInArrow(run, "part int, shard int, doc_id long, offset long, n_tokens long, ids_crc32 long")


def op1_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "wavelet-shards")
    shards = write_shards(common.read(spark, sf_dir, "documents"), common.public_vocabulary("byte_bpe_50k.json"), 2, path)
    out = read_documents(shards).join(shard_starts(shards), ["part", "shard"])
    return out.select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
