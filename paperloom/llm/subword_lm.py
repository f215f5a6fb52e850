"""LM scoring by subword lattice likelihood.

The model is a unigram model over the pieces of an existing vocabulary: a text is words, each with a marker before it, and
an end. Its probability is the sum over all ways to cut it into pieces, which a forward recursion in logarithms gives. As
pieces do not cross words here (a marker only begins a piece), a text's probability is the product of its words', and
each distinct word's is found once.

The vocabulary's own scores weight the pieces at first (log probabilities of a unigram vocabulary; for merge ranks the
weights fall as one over the rank). Expectation steps over the words of all training documents, forward and backward over
each word's lattice, give the expected count of each piece, and so the weights that score. Single bytes are pieces
too, so every text has a probability.

Four passes, none of which shuffles text: (1) chunks of documents become lists of distinct words with training counts,
and of each document's distinct words by number; (2) words meet by hash range, once for each expectation step: totals and
expected counts, vectors of the vocabulary's size, which are added FAN at a time, so that no task and not the driver gets more; (3) words meet again and get their global count and
log probability, which return to their chunks; (4) each chunk adds up its documents.

base_score is that of whole words: the sum over tokens of log10((c + 0.5) / (N + 0.5 (V + 1))).

Cases: null and empty texts are the end alone. Rows repeat as they do in docs, in training too. Without training documents
the vocabulary's scores are used, and N = V = 0. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of text in a chunk, about.
CHUNK = 16 << 20
#: Words up to so many bytes are worked on many at once.
SHORT = 64
#: What the vocabulary's own weights count in the estimate, as a number of pieces.
PRIOR = 1000.0
#: Expectation steps.
ROUNDS = 2
#: Vectors of expected counts that a task adds, or the driver.
FAN = 32
MARKER = 0x20


# ---------------------------------------------------------------- the lattice


@dataclass
class Pieces:
    """A vocabulary as bytes (marker: MARKER), with a weight for each piece; the last weight is that of the end."""

    texts: list[bytes]
    weights: np.ndarray

    @classmethod
    def load(cls, model: bytes) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        unigram = proto.trainer_spec.model_type == 1
        texts: dict[bytes, float] = {bytes([b]): 0.0 for b in range(256)}
        for piece in proto.pieces:
            if piece.type == 1:
                text = piece.piece.encode()
                mark = "▁".encode()
                if mark not in text.removeprefix(mark):
                    text = bytes([MARKER]) + text.removeprefix(mark) if text.startswith(mark) else text
                    texts[text] = math.exp(piece.score) if unigram else 1 / (3 - piece.score)
        least = min((w for w in texts.values() if w > 0), default=1.0)
        weights = np.array([w or least for w in texts.values()])
        return cls(list(texts), np.append(weights / weights.sum() * 0.99, 0.01))


class Lattice:
    """Finds the pieces in words, and sums over all ways to cut them."""

    BITS = 20

    def __init__(self, pieces: Pieces):
        self.longest = max(map(len, pieces.texts))
        self.log = np.log(pieces.weights)
        power, inverse = common.powers(1 << 17)
        self.power, self.inverse = power, inverse * np.uint64(0x9FB21C651E98DF25)
        joined = np.frombuffer(b"".join(pieces.texts), np.uint8)
        ends = np.cumsum([len(x) for x in pieces.texts])
        starts = ends - [len(x) for x in pieces.texts]
        hashes = np.concatenate([self._hash(self._sums(joined[a:b][None]), 0, b - a) for a, b in zip(starts, ends, strict=True)])
        slot = self._slot(hashes)
        self.key, self.piece, self.used = np.zeros(1 << self.BITS, np.uint64), np.zeros(1 << self.BITS, np.int32), np.zeros(1 << self.BITS, bool)
        _, first = np.unique(slot, return_index=True)
        self.key[slot[first]], self.piece[slot[first]], self.used[slot[first]] = hashes[first], first, True
        rest = np.setdiff1d(np.arange(len(hashes)), first)
        rest = rest[np.argsort(hashes[rest])]
        self.more_keys, self.more_pieces = hashes[rest], rest.astype(np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _sums(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        np.cumsum((rows.astype(np.uint64) + np.uint64(1)) * self.power[: rows.shape[1]], axis=1, out=out[:, 1:])
        return out

    def _hash(self, sums: np.ndarray, i: int, j: int) -> np.ndarray:
        return (sums[:, j] - sums[:, i]) * self.inverse[i]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and which pieces they are."""
        slot = self._slot(h)
        at = np.flatnonzero(self.used[slot])
        slot, h = slot[at], h[at]
        piece = np.where(self.key[slot] == h, self.piece[slot], -1)
        if len(self.more_keys):
            other = np.flatnonzero(piece < 0)
            k = np.minimum(np.searchsorted(self.more_keys, h[other]), len(self.more_keys) - 1)
            piece[other] = np.where(self.more_keys[k] == h[other], self.more_pieces[k], -1)
        good = piece >= 0
        return at[good], piece[good]

    def _many(self, rows: np.ndarray, weights: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
        """Log probabilities of words of equal length."""
        n, size = rows.shape
        sums = self._sums(rows)
        forward = np.full((size + 1, n), -np.inf)
        forward[0] = 0
        edges = []
        for j in range(1, size + 1):
            for i in range(max(0, j - self.longest), j):
                at, piece = self.find(self._hash(sums, i, j))
                if len(at):
                    forward[j, at] = np.logaddexp(forward[j, at], forward[i, at] + self.log[piece])
                    edges.append((i, j, at, piece))
        if expected is not None:
            backward = np.full((size + 1, n), -np.inf)
            backward[size] = 0
            for i, j, at, piece in reversed(edges):
                inside = self.log[piece] + backward[j, at]
                backward[i, at] = np.logaddexp(backward[i, at], inside)
            for i, j, at, piece in edges:
                share = np.exp(forward[i, at] + self.log[piece] + backward[j, at] - forward[size, at])
                expected += np.bincount(piece, share * weights[at], len(expected))
        return forward[size]

    def _one(self, word: np.ndarray, weight: float, expected: np.ndarray | None) -> float:
        """The log probability of a long word, place by place."""
        size, step = len(word), 1 << 13
        starts, ends, pieces = [], [], []
        for at in range(0, size, step):
            part = word[at : at + step + self.longest]
            sums = self._sums(part[None])[0]
            for length in range(1, min(self.longest, len(part)) + 1):
                i = np.arange(min(step, len(part) - length + 1))
                found, piece = self.find((sums[i + length] - sums[i]) * self.inverse[i])
                starts.append(found + at)
                ends.append(found + at + length)
                pieces.append(piece)
        starts, ends, pieces = (np.concatenate(x) for x in (starts, ends, pieces))
        order = np.argsort(ends, kind="stable")
        s, p = starts[order], self.log[pieces[order]]
        bounds = np.searchsorted(ends[order], np.arange(size + 2)).tolist()
        forward = np.full(size + 1, -np.inf)
        forward[0] = 0
        for j in range(1, size + 1):
            a, b = bounds[j], bounds[j + 1]
            forward[j] = np.logaddexp.reduce(forward[s[a:b]] + p[a:b])
        if expected is not None:
            order = np.argsort(starts, kind="stable")
            e, p = ends[order], self.log[pieces[order]]
            bounds = np.searchsorted(starts[order], np.arange(size + 2)).tolist()
            backward = np.full(size + 1, -np.inf)
            backward[size] = 0
            for i in range(size - 1, -1, -1):
                a, b = bounds[i], bounds[i + 1]
                backward[i] = np.logaddexp.reduce(backward[e[a:b]] + p[a:b])
            share = np.exp(forward[starts] + self.log[pieces] + backward[ends] - forward[size])
            expected += np.bincount(pieces, share * weight, len(expected))
        return float(forward[size])

    def words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, weights: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """The natural log probability of each word, a marker before it. expected: gets weights times the pieces' expected counts."""
        out = np.zeros(len(starts))
        order = np.argsort(lengths, kind="stable")
        bounds = np.searchsorted(lengths[order], np.arange(SHORT + 2))
        for size in range(1, SHORT + 1):
            same = order[bounds[size] : bounds[size + 1]]
            step = max(1, (1 << 19) // size)
            for at in range(0, len(same), step):
                some = same[at : at + step]
                rows = np.full((len(some), size + 1), MARKER, np.uint8)
                rows[:, 1:] = data[starts[some][:, None] + np.arange(size)]
                out[some] = self._many(rows, None if weights is None else weights[some], expected)
        for k in order[bounds[SHORT + 1] :]:
            word = np.concatenate([np.array([MARKER], np.uint8), data[starts[k] : starts[k] + lengths[k]]])
            out[k] = self._one(word, 0 if weights is None else float(weights[k]), expected)
        return out


# ---------------------------------------------------------------- pass 1: chunks


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, so that a compressor finds the zeros."""
    return np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


CHUNKS = "kind string, chunk long, part long, words binary, lengths binary, counts binary, doc_ids array<bigint>, held_out array<boolean>, tokens array<bigint>, distinct array<int>"
ARROW = pa.schema(
    [
        ("kind", pa.string()), ("chunk", pa.int64()), ("part", pa.int64()), ("words", pa.binary()), ("lengths", pa.binary()), ("counts", pa.binary()),
        ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("tokens", pa.list_(pa.int64())), ("distinct", pa.list_(pa.int32())),
    ]
)


def _chunk_rows(chunk: int, bits: int, bodies: list, lengths: list, per_doc: list, doc_ids: list, held_out: list) -> list[dict]:
    """A row of kind words for each hash range, and one of kind docs."""
    lengths, per_doc = np.concatenate(lengths), np.concatenate(per_doc)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    body = np.concatenate(bodies)
    coded = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
    index, (data, at) = coded.indices.to_numpy(), common.buffers(coded.dictionary)
    n = len(at) - 1
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    counts = np.bincount(index[~np.array(held_out, bool)[doc]], minlength=n) if len(index) else np.zeros(n, np.int64)
    hashes = common.span_hashes(common.prefix_sums(data), at[:-1], at[1:])
    part = (hashes >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.diff(part[order], prepend=-1))
    size = np.diff(at)
    rows = []
    for p, mine in zip(part[order][starts].tolist(), np.split(order, starts[1:]) if n else [], strict=True):
        words = data[common.ranges(at[mine], size[mine])].tobytes()
        rows.append({"kind": "words", "chunk": chunk, "part": p, "words": words, "lengths": _planes(size[mine]), "counts": _planes(counts[mine])})
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    pairs, times = np.unique(doc << 32 | place[index], return_counts=True)
    number = (pairs & 0xFFFFFFFF).astype(np.uint32)
    distinct = np.bincount(pairs >> 32, minlength=len(per_doc)).astype(np.int32)
    steps = np.diff(number, prepend=np.uint32(0))
    rows.append({"kind": "docs", "chunk": chunk, "words": _planes(steps), "counts": _planes(times), "doc_ids": doc_ids, "held_out": held_out, "tokens": (per_doc + 1).tolist(), "distinct": distinct.tolist()})
    return rows


def chunks(docs: DataFrame, held_out: Column) -> DataFrame:
    """CHUNKS of docs(doc_id, text). held_out: the rows that are not learned from."""
    _, size = common.text_size(docs)
    bits = max(0, min(31, math.ceil(math.log2(max(1, size / (CHUNK / 2))))))

    def run(batches):
        base, k = TaskContext.get().partitionId() << 32, 0
        held = [[], [], [], [], []]
        size = 0

        def flush():
            rows = _chunk_rows(base + k, bits, *held)
            return [pa.RecordBatch.from_pylist(rows[i : i + 64], ARROW) for i in range(0, len(rows), 64)]

        for batch in batches:
            for part, data, offsets in common.slices(batch):
                low = common.LOWER[data]
                starts, ends, first = common.word_spans(low, offsets, common.NONSPACE)
                more = (low[common.NONSPACE[low]], ends - starts, np.diff(first))
                for x, y in zip(held, more, strict=False):
                    x.append(y)
                held[3] += part.column("doc_id").to_pylist()
                held[4] += part.column("held_out").to_pylist()
                size += len(data)
                if size >= CHUNK:
                    yield from flush()
                    held, size, k = [[], [], [], [], []], 0, k + 1
        if held[3]:
            yield from flush()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text.alias("text")).mapInArrow(run, CHUNKS)


# ---------------------------------------------------------------- passes 2 and 3: words


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The distinct words of a hash range (bytes, starts, lengths), which of them each row has, counts, and rows by chunk."""
    bodies = [np.frombuffer(x.as_py(), np.uint8) for x in table["words"]]
    lengths = [_numbers(x.as_py()) for x in table["lengths"]]
    sizes = [len(x) for x in lengths]
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths), dtype=np.int64)])
    coded = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(bodies))]).dictionary_encode()
    index, (data, at) = coded.indices.to_numpy(), common.buffers(coded.dictionary)
    counts = np.bincount(index, np.concatenate([_numbers(x.as_py()) for x in table["counts"]]), len(at) - 1).astype(np.int64)
    return data, at, index, counts, sizes


SUMS = "slot long, tokens long, words long, expected binary"


def _expect(sent):
    def run(table: pa.Table) -> pa.Table:
        data, at, _, counts, _ = _gathered(table)
        pieces = sent.value
        known = np.flatnonzero(counts)
        expected = np.zeros(len(pieces.weights))
        Lattice(pieces).words(data, at[:-1][known], np.diff(at)[known], counts[known].astype(float), expected)
        part = table["part"][0].as_py()
        return pa.table({"slot": pa.array([part]), "tokens": pa.array([int(counts.sum())]), "words": pa.array([len(known)]), "expected": pa.array([expected.tobytes()], pa.binary())})

    return run


def _add(table: pa.Table) -> pa.Table:
    expected = sum(np.frombuffer(x.as_py()) for x in table["expected"])
    total = lambda c: pa.array([sum(table[c].to_pylist())])
    return pa.table({"slot": table["slot"][:1], "tokens": total("tokens"), "words": total("words"), "expected": pa.array([expected.tobytes()], pa.binary())})


def added(sums: DataFrame, parts: int, fan: int | None = None) -> DataFrame:
    """SUMS with slots below parts, added up fan at a time until at most fan rows are left."""
    fan = fan or FAN
    while parts > fan:
        sums = sums.withColumn("slot", F.expr(f"slot div {fan}")).groupBy("slot").applyInArrow(_add, SUMS)
        parts = -(-parts // fan)
    return sums


VALUES = "chunk long, part long, counts binary, logs binary"


def _value(sent):
    def run(table: pa.Table) -> pa.Table:
        data, at, index, counts, sizes = _gathered(table)
        logs = Lattice(sent.value).words(data, at[:-1], np.diff(at)) / math.log(10)
        cuts = np.cumsum(sizes)[:-1]
        return pa.table(
            {
                "chunk": table["chunk"],
                "part": table["part"],
                "counts": pa.array([x.tobytes() for x in np.split(counts[index], cuts)], pa.binary()),
                "logs": pa.array([x.tobytes() for x in np.split(logs[index], cuts)], pa.binary()),
            }
        )

    return run


# ---------------------------------------------------------------- pass 4: documents


@dataclass
class Totals:
    """Of the training documents: tokens, distinct tokens (both with the end), documents; and the log10 probability of the end."""

    tokens: int
    words: int
    docs: int
    end: float

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scorer(totals: Totals):
    def run(docs: pa.Table, values: pa.Table) -> pa.Table:
        by_part = sorted(zip(values["part"].to_pylist(), values["counts"].to_pylist(), values["logs"].to_pylist(), strict=True))
        counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for _, x, _ in by_part)])
        logs = np.concatenate([np.zeros(0), *(np.frombuffer(x) for _, _, x in by_part)])
        base = totals.base(counts)
        out = []
        for row in docs.to_pylist():  # one, as chunks are distinct
            number = np.cumsum(_numbers(row["words"]), dtype=np.uint32)
            times = _numbers(row["counts"]).astype(np.float64)
            n = len(row["doc_ids"])
            doc = np.repeat(np.arange(n), row["distinct"])
            add = lambda x: np.bincount(doc, x[number] * times, n)  # noqa: B023, E731
            known = add(counts > 0).astype(np.int64) + (totals.docs > 0)
            columns = [row["doc_ids"], row["held_out"], row["tokens"], known, add(base) + totals.base(np.array(totals.docs)), add(logs) + totals.end]
            types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            out.append(pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(out) if out else pa.table({f: pa.array([], t) for f, t in zip(("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})

    return run


def lattice_scores(docs: DataFrame, held_out: Column, model_path: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    table = common.as_table(chunks(docs, held_out), "chunks", partition_by="kind")
    words = table.where("kind = 'words'").select("chunk", "part", "words", "lengths", "counts")
    first = Pieces.load(common.vocabulary(model_path))
    parts = 1 + (words.agg(F.max("part")).first()[0] or 0)
    learned = F.aggregate(F.transform("held_out", lambda x: F.when(x, 0).otherwise(1).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    of_docs = table.where("kind = 'docs'").agg(F.sum(learned)).first()[0] or 0
    pieces, sums = first, []
    for _ in range(ROUNDS):
        sums = added(words.groupBy("part").applyInArrow(_expect(spark.sparkContext.broadcast(pieces)), SUMS), parts).collect()
        expected = sum((np.frombuffer(bytes(x.expected)) for x in sums), np.zeros(len(first.weights)))
        expected[-1] = of_docs
        weights = expected + PRIOR * first.weights
        pieces = Pieces(first.texts, weights / weights.sum())
    totals = Totals(sum(x.tokens for x in sums) + of_docs, sum(x.words for x in sums) + (of_docs > 0), of_docs, math.log10(pieces.weights[-1]))
    values = words.groupBy("part").applyInArrow(_value(spark.sparkContext.broadcast(pieces)), VALUES)
    each = table.where("kind = 'docs'").select("chunk", "words", "counts", "doc_ids", "held_out", "tokens", "distinct")
    out = each.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInArrow(_scorer(totals), SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def held_out_rows():
    """Rows that are not learned from."""
    return common.crc_remainder("doc_id", 5) == 1


def op6_subword_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(common.read(spark, sf_dir, "documents"), held_out_rows(), common.public_vocabulary("piece_bpe_32k.model"))
