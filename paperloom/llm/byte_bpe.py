"""Byte-level BPE encoding and decoding by monoid tree reduction.

A token sequence is the encoding of its bytes if and only if each adjacent pair of tokens is the encoding of its own bytes:
merges go by rank, then from the left, whatever stands further off, so the first merge across a border of two tokens would come
about with these two alone as well. That makes encodings a monoid. A piece of text (a match of the tokenizer's pattern) is halved
until LEAF bytes are left; these are merged directly, and two neighbours are joined by merging again a window around the border.
The window grows, twice as far each time, on a side where its outermost token and the one beyond aren't the encoding of their
own bytes; once they are on both sides, all tokens outside are right as they stand.

Texts above PART bytes go up such a tree in Spark: they are cut into parts, which are dealt over tasks and encoded, and FAN
neighbours at a time are joined by tasks of a next level. There the pattern is matched anew around the border, from a match
that ended before anything of the border was in the pattern's reach, until a match ends where one of the right part's ended as
well. Decoding concatenates the tokens' bytes; every level's do.

Distinct chunks of texts, of one or a few pieces each, are encoded once in a task (chunk_table.py).

The pattern is matched by the regex library. Where its Unicode classes differ from those of the tiktoken library (two versions of
Unicode), such characters are read as others of the class that they have there, so that matches are the same.

Cases: a null or empty text has no ids and decodes to no bytes. Rows repeat as they do in docs; all columns of docs pass through
untouched, whatever their names; where one is named ids or decoded, the column added gets a _ after it. An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .chunk_table import MOST, ChunkTable
from .wavelet_shards import safe_chunks

#: Bytes of a piece that are merged directly.
LEAF = 16
#: Bytes of a text above which it is cut into parts, and characters of a part.
PART = 1 << 20
#: Parts of a text that are joined in one task of a level.
FAN = 8
#: Bytes of text that are encoded at once; more text shares more distinct pieces.
SLICE = 4 << 20
#: Characters after the end of a match that the pattern may have looked at. Patterns that look further, or behind, need another part size: None.
REACH = 2
# Fixed value: the published pattern of byte-level tokenizers. safe_chunks() is for it; with any other, texts are single chunks.
BYTE_LEVEL = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)


def parse_ranks(file: bytes) -> dict[bytes, int]:
    """Tokens and their ranks, which are their ids, of a file with a token in base64 and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}


@lru_cache(8)
def stand_ins(pattern: str) -> dict[int, int]:
    """Characters that the regex library puts into other classes of the pattern than the tiktoken library, and what to read in their place."""
    import regex
    import tiktoken

    names = list(dict.fromkeys(regex.findall(r"\\[pP]\{[^}]*\}|\\[sSdDwW]", pattern)))
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    code = np.frombuffer(every.encode("utf-32-le"), np.uint32)
    ours, theirs = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    singles = {bytes([k]): k for k in range(256)}
    for k, name in enumerate(names):
        found = [set(regex.findall(name, every)), set(bytes(tiktoken.Encoding("classes", pat_str=name, mergeable_ranks=singles, special_tokens={}).encode_ordinary(every)).decode())]
        for classes, chars in zip((ours, theirs), found, strict=True):
            classes[np.isin(code, [ord(x) for x in chars])] |= 1 << k
    agreed = (code > 127) & (ours == theirs)  # a pattern may name ASCII characters by themselves
    first = {k: int(code[np.flatnonzero(agreed & (ours == k))[0]]) for k in np.unique(theirs[ours != theirs]).tolist()}
    return {int(code[k]): first[int(theirs[k])] for k in np.flatnonzero(ours != theirs)}


class Merges:
    """The encoding of pieces by ranks of merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {rank: token for token, rank in ranks.items()}

    def merged(self, data: bytes) -> list[int]:
        """Merges of least rank first, then from the left, until there is none."""
        n, ranks = len(data), self.ranks
        if n <= 2 * LEAF:
            return self._merged_short(data)
        end, before = [*range(1, n + 1), 0], [*range(-1, n)]
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or end[j] != k:
                continue
            end[i], end[j], before[k] = k, 0, i
            if k < n and (r := ranks.get(data[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, k, end[k]))
            if i and (r := ranks.get(data[before[i] : k])) is not None:
                heapq.heappush(heap, (r, before[i], i, k))
        out, at = [], 0
        while at < n:
            out.append(ranks[data[at : end[at]]])
            at = end[at]
        return out

    def _merged_short(self, data: bytes) -> list[int]:
        """merged() without a heap, faster for few bytes."""
        find, none = self.ranks.get, 1 << 31
        parts = [data[k : k + 1] for k in range(len(data))]
        ranks = [find(a + b, none) for a, b in pairwise(parts)]
        while ranks and (low := min(ranks)) < none:
            k = ranks.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = find(parts[k] + parts[k + 1], none)
            if k:
                ranks[k - 1] = find(parts[k - 1] + parts[k], none)
        return [self.ranks[x] for x in parts]

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def stable(self, left: int, right: int) -> bool:
        return self.merged(self.tokens[left] + self.tokens[right]) == [left, right]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes together, from their encodings."""
        if not a or not b:
            return a or b
        low, high, step = len(a) - 1, 1, 1
        while True:
            window = self.merged(self.bytes_of(a[low:] + b[:high]))
            left = low == 0 or window[0] == a[low] or self.stable(a[low - 1], window[0])
            right = high == len(b) or window[-1] == b[high - 1] or self.stable(window[-1], b[high])
            if left and right:
                return a[:low] + window + b[high:]
            step *= 2
            low, high = low if left else max(0, low - step), high if right else min(len(b), high + step)

    def halved(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self.halved(data[:half]), self.halved(data[half:]))

    def piece(self, data: bytes) -> list[int]:
        """The ids of a match of the pattern; one that is a token is that token."""
        found = self.ranks.get(data)
        return self.halved(data) if found is None else [found]


class Codec:
    """Encodes and decodes many texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, others: dict[int, int]):
        import regex

        self.merges, self.pattern, self.others = Merges(ranks), regex.compile(pattern), others
        self.odd = frozenset(map(chr, others))
        self.table, self.known = ChunkTable(self._encode, 0), {}
        self.splits = pattern in BYTE_LEVEL
        size = max(ranks.values(), default=-1) + 1
        lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.flat = np.frombuffer(b"".join(self.merges.tokens.get(k, b"") for k in range(size)), np.uint8)

    def _piece(self, piece: str) -> list[int]:
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= MOST:
                self.known = {}
            found = self.known[piece] = self.merges.piece(piece.encode())
        return found

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [[i for piece in self.pieces(x.decode()) for i in self._piece(piece)] for x in chunks]
        return np.fromiter((i for x in ids for i in x), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern."""
        if text.isascii() or self.odd.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.others))]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin."""
        starts, first = safe_chunks(data, offsets) if self.splits else (offsets[:-1], np.arange(len(offsets)))
        chunks = common.binary_array(data, starts, np.append(starts[1:], len(data))).dictionary_encode()
        place = self.table.places(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()]
        at = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(self.table.counts[place], out=at[1:])
        return self.table.gathered(place), at[first]

    def encode_part(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a text, and where each piece begins in them."""
        ids = [self._piece(x) for x in self.pieces(text)]
        return np.array([i for x in ids for i in x], np.int32), np.array([*accumulate(map(len, ids), initial=0)][:-1], np.int64)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        lengths = self.lengths[ids]
        before = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(lengths, out=before[1:])
        body = self.flat[common.ranges(self.starts[ids], lengths)]
        return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(before[at]), pa.py_buffer(body)]).cast(pa.binary())

    # ------------------------------------------------------------ parts of a text: their ids, and where each piece begins in them

    def _texts(self, part, low: int, high: int) -> list[str]:
        """Pieces low to high of a part."""
        ids, starts = part
        ends = np.append(starts, len(ids))
        return [self.merges.bytes_of(ids[ends[k] : ends[k + 1]].tolist()).decode() for k in range(low, high)]

    def _joined_piece(self, piece: str, left: list[str], right: list[str], a, b) -> list[int]:
        """The ids of a piece; one that is the last piece of a and the first of b goes by their ids."""
        data = piece.encode()
        if data in self.merges.ranks or not left or not right or piece != left[-1] + right[0]:
            return self.merges.piece(data)
        sides = a[0][a[1][-1] :].tolist(), b[0][: b[1][1] if len(b[1]) > 1 else len(b[0])].tolist()
        # A piece that is a token by itself may be one that merges don't lead to.
        return self.merges.join(*(self.merges.merged(self.merges.tokens[x[0]]) if len(x) == 1 else x for x in sides))

    def join(self, a, b, reach: int):
        """Two neighbouring parts as one."""
        if not len(a[0]) or not len(b[0]):
            return a if len(a[0]) else b
        from_, left = len(a[1]), []
        while from_ and sum(map(len, left)) < reach:
            from_ -= 1
            left[:0] = self._texts(a, from_, from_ + 1)
        border, most, right = sum(map(len, left)), 4, []
        while True:
            most = min(most, len(b[1]))
            right += self._texts(b, len(right), most)
            window = self.pieces("".join(left) + "".join(right))
            ends = [0, *accumulate(map(len, window))]
            sure = ends[-1] if most == len(b[1]) else ends[-1] - reach
            borders = {border + x: k for k, x in enumerate(accumulate(map(len, right), initial=0))}
            same = next((x for x in ends if x in borders and x <= sure), None)
            if same is not None:
                break
            most *= 2
        new = [self._joined_piece(x, left, right, a, b) for x, end in zip(window, ends[1:], strict=True) if end <= same]
        kept = borders[same]
        cut_a, cut_b = a[1][from_], b[1][kept] if kept < len(b[1]) else len(b[0])
        counts = [*accumulate(map(len, new), initial=0)]
        ids = np.concatenate([a[0][:cut_a], np.array([i for x in new for i in x], np.int32), b[0][cut_b:]])
        starts = np.concatenate([a[1][:from_], cut_a + np.array(counts[:-1], np.int64), b[1][kept:] - cut_b + cut_a + counts[-1]])
        return ids.astype(np.int32), starts.astype(np.int64)

    def reduced(self, parts: list, reach: int):
        """Consecutive parts as one, by halves."""
        half = len(parts) // 2
        return parts[0] if len(parts) == 1 else self.join(self.reduced(parts[:half], reach), self.reduced(parts[half:], reach), reach)


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))


def _codec(made):
    """A function that makes the codec of broadcast parts, once in a task."""

    def codec() -> Codec:
        file, pattern, others = made.value
        return Codec(parse_ranks(file), pattern, others)

    return codec


def _whole(docs: DataFrame, codec, names: tuple[str, str], decode: bool) -> DataFrame:
    def run(batches):
        own = codec()
        for batch in batches:
            for part, data, offsets in common.slices(batch, most=SLICE):
                ids, at = own.encode(data, offsets)
                yield common.with_columns(part, **{names[0]: _lists(ids, at)} | ({names[1]: own.decode(ids, at)} if decode else {}))

    return docs.mapInArrow(run, _schema(docs, names, decode))


def _schema(docs: DataFrame, names: tuple[str, str], decode: bool) -> T.StructType:
    return T.StructType([*docs.schema.fields, T.StructField(names[0], T.ArrayType(T.IntegerType()))] + [T.StructField(names[1], T.BinaryType())] * decode)


_PART = "rid long, part long, ids array<int>, starts array<int>"


def _in_parts(docs: DataFrame, codec, names: tuple[str, str], decode: bool, part: int, reach: int) -> DataFrame:
    """Texts that are cut into parts, and go up the tree a level at a time."""
    rows, rid = common.numbered(docs, "long-texts")

    def row(key: int, at: int, ids: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([at], pa.int64()), _lists(ids, [0, len(ids)]), _lists(starts, [0, len(starts)])], names=["rid", "part", "ids", "starts"])

    def cut(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k in range(0, len(text), part):
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([k // part], pa.int64()), pa.array([text[k : k + part]])], names=["rid", "part", "text"])

    def encode(batches):
        own = codec()
        for batch in batches:
            for key, at, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                yield row(key, at, *own.encode_part(text))

    def level(batches):
        own = codec()
        array = lambda x, kind: np.array(x, kind)
        for batch in batches:
            for key, at, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids, starts = own.reduced([(array(x["ids"], np.int32), array(x["starts"], np.int64)) for x in parts], reach)
                yield row(key, at, ids, starts)

    tasks = max(common.shuffle_partitions(docs.sparkSession), (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (4 * part))
    parts = rows.select(F.col(rid).alias("rid"), F.col("text")).mapInArrow(cut, "rid long, part long, text string")
    parts = common.as_table(parts.repartition(int(tasks), "rid", "part").mapInArrow(encode, _PART), "parts")
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        groups = parts.groupBy("rid", F.expr(f"part div {FAN}").alias("part")).agg(F.array_sort(F.collect_list(F.struct("part", "ids", "starts"))).alias("parts"))
        parts = common.as_table(groups.mapInArrow(level, _PART), "parts")

    def decoded(batches):
        own = codec()
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids = row.column(names[0]).flatten().to_numpy()
                yield common.with_columns(row, **{names[1]: own.decode(ids, np.array([0, len(ids)]))})

    out = rows.join(parts.select(F.col("rid").alias(rid), F.col("ids").alias(names[0])), rid).select(*(f"`{c}`" for c in docs.columns), names[0])
    return out.mapInArrow(decoded, _schema(docs, names, True)) if decode else out


def encode(docs: DataFrame, ranks_path: str, pattern: str, decode: bool = False, part: int = PART, reach: int | None = REACH) -> DataFrame:
    """docs with ids (array<int>) of the column text, and with decoded, their bytes, if asked for.

    reach: characters after the end of a match that the pattern may have looked at; None: unknown, so that no text is cut.
    """
    made = docs.sparkSession.sparkContext.broadcast((common.vocabulary(ranks_path), pattern, stand_ins(pattern)))
    codec, names = _codec(made), (common.free_name(docs, "ids"), common.free_name(docs, "decoded"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    if reach is None or (docs.agg(F.max(size)).first()[0] or 0) <= part:
        return _whole(docs, codec, names, decode)
    return _whole(docs.where(size <= part), codec, names, decode).unionByName(_in_parts(docs.where(size > part), codec, names, decode, part, reach))


def digests(docs: DataFrame, ranks_path: str, pattern: str, **more) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs(doc_id, text)."""
    out = encode(docs.select("doc_id", F.col("text").cast("string").alias("text")), ranks_path, pattern, decode=True, **more)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
