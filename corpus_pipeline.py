"""From documents to token ids in five stages: toxic documents go, then exact copies, then near copies (one of each group
stays), then documents contaminated with benchmark text; what is left is encoded with SentencePiece.

Each stage is a function of (spark, docs, sf_dir), whose result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. A stage first deletes the temporary tables of the stage before, whose result
is stored by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import common, decontaminate, exact_dedup, jaccard_join, sentence_pieces, toxicity as toxicity_model


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark)
    return toxicity_model.drop_toxic(docs, common.read(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark)
    return jaccard_join.drop_similar(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark)
    return decontaminate.drop_contaminated(docs, common.read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the documents that are left."""
    common.release(spark)
    return sentence_pieces.digests(docs, common.public_vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", contamination),
    ("SentencePiece encoding", tokens),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = common.read(spark, sf_dir, "documents"), common.shared_dir(spark).rstrip("/")
    for k, (_, stage) in enumerate(STAGES):
        path = common.unique(f"{folder}/pipeline-{k}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    common.release(spark)
    return docs
