"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent, each hashed into 2**BITS places: words, word stems (the first bytes of a word), pairs of
adjacent words and pairs with one word between. FTRL-proximal gives each coordinate a learning rate of its own and, by L1,
leaves most weights exactly zero; what is left is collected and broadcast (2**BITS weights at most).

It is fitted in one task on a bounded sample of labelled rows: the first documents in the order of a hash of their doc_id, MOST
of them and MOST_BYTES of their texts at most. A doc_id is learned from once: of repeated labels the largest counts, of repeated
documents the text that sorts first. All documents are scored, whole.

Cases: a null or empty text has no features and gets the score of the intercept. Labels that are null are left out; without
any the score is near 0.1. Rows repeat as they do in docs. All columns of docs pass through, whatever their names; where one has
the name of the column added, that gets a _ after it. Empty tables work.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bits of a feature's hash.
BITS = 20
#: Bytes of the stems.
STEMS = (4, 5)
#: Labelled documents to learn from, at most.
MOST = 10_000
#: Bytes of their texts, at most, so that one task can hold their features.
MOST_BYTES = 64 << 20
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.0
THRESHOLD = 0.5


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) of each place in some texts, for each kind of feature; they repeat as words do."""
    low = common.LOWER[data]
    starts, ends, first = common.word_spans(low, offsets, common.ALNUM)
    sums = common.prefix_sums(low)
    words = common.span_hashes(sums, starts, ends)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    kinds = [(text, words)]
    kinds += [(text, common.span_hashes(sums, starts, np.minimum(ends, starts + n)) ^ np.uint64(n << 56)) for n in STEMS]
    for gap in (1, 2):
        same = text[gap:] == text[:-gap]
        pair = common.mix(words[:-gap] * np.uint64(0xD6E8FEB86659FD93) + words[gap:] + np.uint64(gap))
        kinds.append((text[gap:][same], pair[same]))
    return [(t, (h >> np.uint64(64 - BITS)).astype(np.int32)) for t, h in kinds]


def distinct_features(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, feature) pairs, sorted; only chosen features, if given (a flag for each)."""
    pairs = []
    for text, feature in features(data, offsets):
        if chosen is not None:
            keep = chosen[feature]
            text, feature = text[keep], feature[keep]
        pairs.append(text.astype(np.int64) << 32 | feature)
    pairs = np.unique(np.concatenate(pairs))
    return pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.int32)


@dataclass
class Weights:
    feature: np.ndarray
    weight: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.feature] = self.weight
        return out


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Weights:
    """FTRL-proximal over texts, given as their distinct features, in this order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    positive = float(labels.sum())
    intercept, total = np.log((positive + 0.1) / (len(labels) - positive + 1)), 1.0
    for _ in range(epochs):
        for x, y in zip(texts, labels.tolist(), strict=True):
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) > L1, (np.sign(zx) * L1 - zx) / ((BETA + root) / ALPHA + L2), 0.0)
            g = 1 / (1 + np.exp(-np.clip(intercept + w.sum(), -35, 35))) - y
            n[x] = nx + g * g
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / ALPHA * w
            total += g * g
            intercept -= ALPHA / (BETA + np.sqrt(total)) * g
    w = np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    at = np.flatnonzero(w)
    return Weights(at, w[at], float(intercept))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, train: Column | None, most_bytes: int | None = None) -> DataFrame:
    """(rank, label, text) of a bounded sample of labelled documents, each doc_id once; rank orders them by a hash of doc_id.

    labels: doc_id and label of documents. train: which of its rows may be learned from.
    """
    rows = labels if train is None else labels.where(train)
    rows = rows.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).cast("int").alias("label"))
    rows = rows.withColumn("rank", F.xxhash64("_id")).orderBy("rank", "_id").limit(most)
    # The sample is bounded, so its ids can be broadcast: the texts stay where they are.
    docs = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = docs.join(F.broadcast(rows), "_id").groupBy("_id", "rank", "label").agg(F.min("text").alias("text"))
    found = common.as_table(found, "labelled")
    # In one task, the lengths alone: MOST rows at most.
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy("rank", "_id").rowsBetween(Window.unboundedPreceding, -1))
    sizes = found.select("_id", F.coalesce(so_far, F.lit(0)).alias("before")).where(F.col("before") < (most_bytes or MOST_BYTES))
    return found.join(F.broadcast(sizes), "_id").select("rank", "label", "text")


def in_one_task(rows: DataFrame, order: list[str], fit_rows: Callable, schema: str) -> DataFrame:
    """A function over the rows of a bounded table, in order, in one task."""
    return rows.repartition(1).sortWithinPartitions(*order).mapInArrow(fit_rows, schema)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", train: Column | None = None, most: int = MOST) -> Weights:
    """Weights from documents(doc_id, text) with labels(doc_id, label)."""

    def prepare(batches):
        for batch in batches:
            for part, data, offsets in common.slices(batch):
                text, feature = distinct_features(data, offsets)
                bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
                packed = [feature[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("rank"), part.column("label"), pa.array(packed, pa.binary())], names=["rank", "label", "features"])

    def train_rows(batches):
        texts, marks = [], []
        for batch in batches:
            for x, y in zip(batch.column("features"), batch.column("label").to_pylist(), strict=True):
                if len(texts) < most:
                    texts.append(np.frombuffer(x.as_py(), np.int32))
                    marks.append(y)
        found = fit(texts, np.array(marks, np.float64))
        feature = np.append(found.feature, -1)
        weight = np.append(found.weight, found.intercept)
        yield pa.RecordBatch.from_arrays([pa.array(feature, pa.int64()), pa.array(weight)], names=["feature", "weight"])

    rows = labelled_sample(docs, labels, label, most, train).mapInArrow(prepare, "rank long, label int, features binary")
    found = in_one_task(rows, ["rank", "label", "features"], train_rows, "feature long, weight double").toPandas().sort_values("feature")
    if not len(found):
        return Weights(np.zeros(0, np.int64), np.zeros(0), float(np.log(0.1)))
    return Weights(found.feature.to_numpy()[1:], found.weight.to_numpy()[1:], float(found.weight.iloc[0]))


def scores(docs: DataFrame, weights: Weights, column: str = "score") -> DataFrame:
    """docs(text, ...) with the probability of label 1, in a column of this name, with _ after it if docs has one."""
    column = common.free_name(docs, column)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        weight, intercept = sent.value.dense(), sent.value.intercept
        chosen = weight != 0
        for batch in batches:
            for part, data, offsets in common.slices(batch):
                text, feature = distinct_features(data, offsets, chosen)
                logit = np.bincount(text, weight[feature], part.num_rows) + intercept
                yield common.with_columns(part, **{column: 1 / (1 + np.exp(-np.clip(logit, -35, 35)))})

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def train_rows():
    """Rows that labels are learned from."""
    return common.crc_remainder("doc_id", 5) != 0


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs below the threshold; all columns of docs."""
    score = common.free_name(docs, "_toxicity")
    return scores(docs, learn(docs, labels, train=train_rows()), score).where(F.col(score) < THRESHOLD).drop(score)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    out = scores(docs, learn(docs, common.read(spark, sf_dir, "labels"), train=train_rows()))
    return out.select("doc_id", (~train_rows()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
