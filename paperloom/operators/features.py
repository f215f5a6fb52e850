"""Words that tell two classes of texts apart, and features of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.porter import stems, with_stems
from ..functions.text import parts_of, plain_or_words, times_of, words_of_rows
from ..functions.text import words as word_list

# Fixed value: what counts as a number among words, and what stands for any number.
NUMBER, ANY_NUMBER = r"^\d*(\.)?\d+$", "###"


def _words(text: str, stem: bool, stop_words: list[str] = (), numbers: str = "specific"):
    words = word_list(F.col(text))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(list(stop_words)))
    if numbers == "remove":
        words = F.filter(words, lambda w: ~w.rlike(NUMBER))
    elif numbers == "any":
        words = F.transform(words, lambda w: F.when(w.rlike(NUMBER), ANY_NUMBER).otherwise(w))
    return stems(words) if stem else words


def distinctive_words(
    df: DataFrame,
    text: str = "text",
    classification: str = "classification",
    n: int | None = None,
    stop_words: list[str] = (),
    numbers: str = "any",
    stem: bool = True,
    min_total: float | None = None,
) -> DataFrame:
    """(word, n_<a>, n_<b>, total, freq_<a>, freq_<b>, difference) of the words that differ most between two classes.

    freq is a count over the number of texts in the class; words that occur fewer than min_total times (a tenth of the
    texts, unless given) are left out. numbers: any (### for each), specific or remove. Ties are in the order of the words.
    """
    if numbers not in ("any", "specific", "remove"):
        raise ValueError("numbers must be any, specific or remove")
    sizes = {r[classification]: r["count"] for r in df.groupBy(classification).count().orderBy(classification).limit(3).collect()}
    if len(sizes) != 2 or None in sizes:
        raise ValueError("there must be exactly two classes")
    least = sum(sizes.values()) / 10 if min_total is None else min_total
    each = df.select(F.col(classification).alias("_class"), F.explode(_words(text, False, stop_words, numbers)).alias("word"))
    names = {c: str(c) for c in sizes}
    counts = each.groupBy("word").agg(*(F.count_if(F.col("_class") == c).alias(f"n_{names[c]}") for c in sizes))
    if stem:  # counted first, so that each distinct word is stemmed once
        stemmed = with_stems(counts).withColumn("word", F.col("stem"))
        counts = stemmed.groupBy("word").agg(*(F.sum(f"n_{n}").alias(f"n_{n}") for n in names.values()))
    (a, size_a), (b, size_b) = ((names[c], k) for c, k in sizes.items())
    counts = counts.withColumn("total", F.col(f"n_{a}") + F.col(f"n_{b}")).where(F.col("total") >= least)
    counts = counts.withColumn(f"freq_{a}", F.col(f"n_{a}") / size_a).withColumn(f"freq_{b}", F.col(f"n_{b}") / size_b)
    counts = counts.withColumn("difference", F.abs(F.col(f"freq_{a}") - F.col(f"freq_{b}")))
    out = counts.orderBy(F.desc("difference"), "word")
    return out.limit(n) if n is not None else out


def text_features(
    df: DataFrame,
    words: list[str],
    text: str = "text",
    word_count: bool = True,
    has_number: bool = True,
    has_symbol: dict[str, str] | list[str] | None = None,
    stem: bool = True,
    values: str = "presence",
) -> DataFrame:
    """df with a column for each feature: word_count, has_number, one for each symbol, and one for each word.

    A text's words are an array in its own row, so there is no shuffle. values: presence (0 or 1) or count. The word ### asks
    for has_number.
    """
    if values not in ("presence", "count"):
        raise ValueError("values must be presence or count")
    symbols = {"has_equals": "="} if has_symbol is None else has_symbol if isinstance(has_symbol, dict) else {f"has_{x}": x for x in has_symbol}
    has_number = has_number or ANY_NUMBER in words
    words = [w for w in words if w != ANY_NUMBER]
    source = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_words", F.coalesce(_words(text, stem), F.array().cast("array<string>")))
    added = {}
    if word_count:
        added["word_count"] = F.size("_words")
    if has_number:
        added["has_number"] = source.rlike(r"\d").cast("int")
    for name, symbol in symbols.items():
        added[name] = source.contains(symbol).cast("int")
    for w in words:
        # How often: the words that removing it takes away.
        added[w] = F.array_contains("_words", w).cast("int") if values == "presence" else F.size("_words") - F.size(F.array_remove("_words", w))
    return out.withColumns({k: F.coalesce(v, F.lit(0)) for k, v in added.items()}).drop("_words")


def feature_classifier(df: DataFrame, label: str, names: list[str]):
    """A logistic regression on feature columns, as a fitted pipeline of Spark's own: transform(df) adds prediction."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    stages = [VectorAssembler(inputCols=names, outputCol="_features"), LogisticRegression(featuresCol="_features", labelCol=label)]
    return Pipeline(stages=stages).fit(df)


#: Words of a vocabulary, which the driver holds: those that most texts have.
VOCABULARY = 1 << 16


def _texts_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) for each part of batches of plain_or_words: how many of its texts have the word."""
    for part in (part for batch in batches for part in parts_of(*batch.columns)):
        words, rows, codes = words_of_rows(*part)
        once, _ = times_of(rows * max(len(words), 1) + codes)
        n = np.bincount(once % max(len(words), 1), minlength=len(words))
        yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], ["word", "n"])


class WordClassifier:
    """A logistic regression on the words of texts, as sparse vectors of a fitted vocabulary."""

    def __init__(self, vocabulary: list[str], model, text: str, binary: bool):
        self.vocabulary, self.model, self.text, self.binary = vocabulary, model, text, binary

    def features(self, df: DataFrame) -> DataFrame:
        """df with _features, a sparse vector; a text without known words has an empty one."""
        from pyspark.ml.linalg import VectorUDT

        known, size, binary = df.sparkSession.sparkContext.broadcast(self.vocabulary), len(self.vocabulary), self.binary

        @F.arrow_udf(VectorUDT())
        def vectors(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            vocabulary = pa.array(known.value, pa.string())
            for part in (part for batch in batches for part in parts_of(*batch)):
                words, rows, codes = words_of_rows(*part)
                places = pc.fill_null(pc.index_in(words, vocabulary), -1).to_numpy().astype(np.int64)[codes]
                cells, times = times_of((rows * size + places)[places >= 0])
                ends = np.searchsorted(cells, np.arange(len(part[0]) + 1, dtype=np.int64) * size).astype(np.int32)
                values = np.ones(len(cells)) if binary else times.astype(float)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((cells % size).astype(np.int32), values)]
                yield pa.StructArray.from_arrays([pa.array(np.zeros(len(part[0]), np.int8)), pa.array(np.full(len(part[0]), size, np.int32)), *lists], ["type", "size", "indices", "values"])

        return df.withColumn("_features", vectors(*plain_or_words(F.col(self.text))))

    def transform(self, df: DataFrame) -> DataFrame:
        """df with probability (of label 1) and prediction, in place of columns with these names."""
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(self.features(df))
        own = [F.col(f"`{c}`") for c in df.columns if c not in ("probability", "prediction")]
        return out.select(*own, F.get(vector_to_array("_probability"), F.lit(1)).alias("probability"), F.col("_prediction").cast("int").alias("prediction"))

    def weights(self) -> dict[str, float]:
        return dict(zip(self.vocabulary, self.model.coefficients.toArray().tolist(), strict=True))


def word_classifier(df: DataFrame, text: str = "text", label: str = "label", least: int = 2, most: int = VOCABULARY, ridge: float = 0.01, binary: bool = True) -> WordClassifier:
    """Fits a logistic regression of label (0 or 1) on the words of texts, each present or not (binary) or counted.

    The vocabulary are the words in at least so many of the texts, at most the given number of them, the commonest first. The texts are sparse
    vectors, made once and kept on disk while it is fitted, so the width of the data does not grow with the vocabulary; Spark adds up gradients
    over all partitions. Rows without label are left out.
    """
    from pyspark.ml.classification import LogisticRegression

    rows = df.where(F.col(label).isNotNull())
    each = rows.select(*(c.alias(name) for name, c in zip(("plain", "words"), plain_or_words(F.col(text)), strict=True)))
    counts = each.mapInArrow(_texts_with, "word string, n long").groupBy("word").agg(F.sum("n").alias("count")).where(F.col("count") >= least)
    vocabulary = [r.word for r in counts.orderBy(F.desc("count"), "word").limit(most).collect()]
    if not vocabulary:
        raise ValueError(f"no word is in {least} texts")
    out = WordClassifier(vocabulary, None, text, binary)
    fit = LogisticRegression(featuresCol="_features", labelCol="_label", probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw", regParam=ridge, standardization=False, tol=1e-12, maxIter=1000)
    vectors = out.features(rows).select("_features", F.col(label).cast("double").alias("_label")).persist(StorageLevel.DISK_ONLY)
    try:
        out.model = fit.fit(vectors)
    finally:
        vectors.unpersist()
    return out
