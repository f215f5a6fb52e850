"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words each, over its whole text. Each passage is encoded as a vector: shares of
kinds of characters and words, repetition, and a signed hash projection of its words. A small network maps a passage to a
hidden vector; gated attention weights the passages of a document, and the weighted sum is scored. Only documents carry
labels: the attention learns which passages matter.

It is fitted in one task on a bounded sample of labelled rows: the first documents in the order of a hash of their doc_id, MOST
of them and toxicity.MOST_BYTES of their texts at most, each doc_id once (of repeated labels the largest counts, of repeated
documents the text that sorts first).
The network has a few thousand parameters, which are broadcast. All documents are scored, whole.

Cases: a document without words (null or empty texts too) is one empty passage. Labels that are null are left out; without
any, all documents get the same score. Rows repeat as they do in docs. All columns of docs pass through, whatever their names;
where one has the name of the column added, that gets a _ after it. Empty tables work.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .toxicity import in_one_task, labelled_sample

#: Words of a passage.
PASSAGE = 64
#: Labelled documents to learn from, at most.
MOST = 8_000
#: Numbers of the hash projection, of the hidden vector, of the attention.
PROJECTION, HIDDEN, ATTENTION = 32, 24, 12
EPOCHS, BATCH, RATE, DECAY = 15, 32, 0.01, 1e-4
THRESHOLD = 0.7

#: Kinds of bytes that are counted: capitals, small letters, digits, line ends, above 7F, and some marks.
KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"\n", bytes(range(128, 256)), b"!", b"|", b".,;:?", b"*#$%&@^~=+<>{}[]\\/_", b"()'\"-"]
WORD_FEATURES = 8
WIDTH = len(KINDS) + WORD_FEATURES + PROJECTION


def _kind_of() -> np.ndarray:
    out = np.full(256, len(KINDS), np.int64)
    for k, chars in enumerate(KINDS):
        out[list(chars)] = k
    return out


KIND = _kind_of()


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of all passages of some texts, and the index of each text's first passage (one more than texts)."""
    texts = len(offsets) - 1
    low = common.LOWER[data]
    starts, ends, first = common.word_spans(low, offsets, common.NONSPACE)
    counts = np.diff(first)
    of_text = np.maximum(1, -(-counts // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(of_text)])
    total = int(bounds[-1])
    text = np.repeat(np.arange(texts), counts)
    place = np.arange(len(starts)) - first[:-1][text]
    passage = bounds[:-1][text] + place // PASSAGE
    # Every byte belongs to the passage of the last word that began before it, or the text's first.
    at = np.zeros(len(data) + 1, np.int64)
    opens = np.flatnonzero(np.diff(passage, prepend=-1) > 0) if len(passage) else np.zeros(0, np.int64)
    cuts = np.where(place[opens] == 0, offsets[:-1][text[opens]], starts[opens])
    np.add.at(at, cuts, 1)
    byte_passage = passage[opens][np.maximum(np.cumsum(at)[: len(data)] - 1, 0)] if len(opens) else np.zeros(len(data), np.int64)
    blank = np.flatnonzero((counts == 0) & (np.diff(offsets) > 0))
    for t in blank:
        byte_passage[offsets[t] : offsets[t + 1]] = bounds[t]
    out = np.zeros((total, WIDTH), np.float32)
    n = len(KINDS)
    chars = np.bincount(byte_passage * (n + 1) + KIND[data], minlength=total * (n + 1)).reshape(total, n + 1)
    out[:, :n] = chars[:, :n] / np.maximum(1, chars.sum(1))[:, None]
    if len(starts):
        hashes = common.span_hashes(common.prefix_sums(low), starts, ends)
        words = np.bincount(passage, minlength=total)
        per = np.maximum(1, words)
        length = ends - starts
        same = lambda gap: np.concatenate([np.zeros(gap, bool), (hashes[gap:] == hashes[:-gap]) & (text[gap:] == text[:-gap])])[: len(starts)]
        lead = KIND[data[starts]]
        order = np.lexsort((hashes, passage))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
        mean = np.bincount(passage, length, total) / per
        values = [
            mean / 10,
            np.sqrt(np.maximum(0, np.bincount(passage, length.astype(float) ** 2, total) / per - mean**2)) / 10,
            np.bincount(passage, same(1), total) / per,
            np.bincount(passage, same(2), total) / per,
            np.bincount(passage[order], new, total) / per,
            np.bincount(passage, lead == 0, total) / per,
            np.bincount(passage, length == 1, total) / per,
            words / PASSAGE,
        ]
        for k, v in enumerate(values):
            out[:, n + k] = v
        sign = np.where(hashes >> np.uint64(63), 1.0, -1.0)
        slot = (hashes >> np.uint64(40)).astype(np.int64) % PROJECTION
        out[:, n + WORD_FEATURES :] = np.bincount(passage * PROJECTION + slot, sign, total * PROJECTION).reshape(total, PROJECTION) / np.sqrt(per)[:, None]
    return out, bounds


# ---------------------------------------------------------------- the network


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, bounds[:-1], axis=0)


class Network:
    """Gated attention over the passages of each document."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {
            "w": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "v": draw(HIDDEN, ATTENTION), "v0": np.zeros(ATTENTION), "u": draw(HIDDEN, ATTENTION), "u0": np.zeros(ATTENTION),
            "a": draw(ATTENTION), "c": draw(HIDDEN), "c0": np.zeros(1),
        }
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict:
        p, bag = self.p, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"] + p["v0"]), 1 / (1 + np.exp(-(h @ p["u"] + p["u0"])))
        e = (t * s) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, bounds[:-1])[bag])
        attention = e / _sums(e, bounds)[bag]
        z = _sums(attention[:, None] * h, bounds)
        return {"bag": bag, "h": h, "t": t, "s": s, "attention": attention, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"], -35, 35)))}

    def gradients(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict:
        p, f = self.p, self.forward(x, bounds)
        bag, h, t, s, attention = f["bag"], f["h"], f["t"], f["s"], f["attention"]
        d = (f["score"] - y) / len(y)
        dz = (d[:, None] * p["c"])[bag]
        da = (h * dz).sum(1)
        de = attention * (da - _sums(attention * da, bounds)[bag])
        dg = de[:, None] * p["a"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (attention[:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (1 - h * h)
        return {
            "w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "v0": dt.sum(0), "u": h.T @ ds, "u0": ds.sum(0),
            "a": (t * s).T @ de, "c": f["z"].T @ d, "c0": np.array([d.sum()]),
        }

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.scale, bounds)["score"]

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Network:
        """Adam on batches of documents, given as the vectors of their passages."""
        if not bags:
            return self
        every = np.concatenate(bags).astype(np.float64)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        bags = [(x - self.mean) / self.scale for x in bags]
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.p["c0"][0] = np.log(share / (1 - share))
        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        steps = epochs * -(-len(bags) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                bounds = np.concatenate([[0], np.cumsum([len(bags[k]) for k in some])])
                grads = self.gradients(np.concatenate([bags[k] for k in some]), bounds, y[some])
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                for k, g in grads.items():
                    g = g + DECAY * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, mean=self.mean, scale=self.scale, **{f"p_{k}": v for k, v in self.p.items()})
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Network:
        out, stored = cls(), np.load(io.BytesIO(data))
        out.mean, out.scale = stored["mean"], stored["scale"]
        out.p = {k: stored[f"p_{k}"] for k in out.p}
        return out


# ---------------------------------------------------------------- over tables


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None, most: int = MOST) -> Network:
    """A network from documents(doc_id, text) with labels(doc_id, label)."""

    def prepare(batches):
        for batch in batches:
            for part, data, offsets in common.slices(batch):
                x, bounds = passages(data, offsets)
                packed = [x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("rank"), part.column("label"), pa.array(packed, pa.binary())], names=["rank", "label", "passages"])

    def train_rows(batches):
        bags, marks = [], []
        for batch in batches:
            for x, y in zip(batch.column("passages"), batch.column("label").to_pylist(), strict=True):
                if len(bags) < most:
                    bags.append(np.frombuffer(x.as_py(), np.float32).reshape(-1, WIDTH))
                    marks.append(y)
        yield pa.RecordBatch.from_arrays([pa.array([Network().fit(bags, np.array(marks, np.float64)).pack()], pa.binary())], names=["network"])

    rows = labelled_sample(docs, labels, label, most, train).mapInArrow(prepare, "rank long, label int, passages binary")
    found = in_one_task(rows, ["rank", "label", "passages"], train_rows, "network binary").collect()
    return Network.unpack(bytes(found[0].network)) if found else Network()


def scores(docs: DataFrame, network: Network, column: str = "score") -> DataFrame:
    """docs(text, ...) with the probability of label 1, in a column of this name, with _ after it if docs has one."""
    column = common.free_name(docs, column)
    sent = docs.sparkSession.sparkContext.broadcast(network.pack())

    def run(batches):
        net = Network.unpack(sent.value)
        for batch in batches:
            for part, data, offsets in common.slices(batch):
                yield common.with_columns(part, **{column: net.score(*passages(data, offsets))})

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def train_rows():
    """Rows that labels are learned from."""
    return common.crc_remainder("doc_id", 4) != 2


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    out = scores(docs, learn(docs, common.read(spark, sf_dir, "labels"), train=train_rows()))
    return out.select("doc_id", (~train_rows()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
