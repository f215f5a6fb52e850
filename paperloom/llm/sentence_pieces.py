"""SentencePiece encoding and decoding by a distinct-chunk table.

If no piece of the model has its whitespace marker after another character, white space stays as it is and a marker has a piece of its
own (checked when a model is loaded), then pieces cannot cross from one marked word to the next. So each distinct marked word, with the
run of markers before it, is segmented once in a task, by the library, and its ids are joined back to all places of that word. Models for
which that doesn't hold are used on whole texts. Decoding is the library's, over all ids of a text.

Cases: a null or empty text has no ids but the end id, and decodes to an empty text. Rows repeat as they do in docs; all
columns of docs pass through untouched, whatever their names; where one is named ids or decoded, the column added gets a _ after it.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .chunk_table import ChunkTable, text_array

MARK = "▁"
#: Bytes of text that are encoded at once; more text shares more distinct words.
SLICE = 4 << 20


def marked_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the chunks, each a run of spaces or markers with the word after it, and each text's first chunk."""
    space = data == 0x20
    mark = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
    for k in range(3 if mark.any() else 0):
        space[k : len(data) - 2 + k] |= mark
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, offsets)


class Codec:
    """Encodes and decodes many texts with a model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        # The model puts one marker before a text, reads spaces as markers, and drops none.
        plain = self.model.encode(MARK + "a " + MARK + "b ") == self.model.encode(" a  b ") != self.model.encode("a b") and self.model.encode("") == []
        self.mark = self.model.piece_to_id(MARK)
        self.splits = plain and self.mark != self.model.unk_id() and not any(MARK in x.lstrip(MARK) for x in pieces)
        self.end = self.model.eos_id()
        self.table = ChunkTable(self._encode, self.end)

    def _encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # The model puts a marker before each text; it stands for the chunk's first one. It puts none before an empty one.
        rest = [(x[1:] if x[:1] == b" " else x[3:]).decode("utf-8", "replace") for x in chunks]
        ids = [x if text else [self.mark] for x, text in zip(self.model.encode(rest), rest, strict=True)]
        return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, an end id after each text, and where each text's begin."""
        if self.splits:
            starts, first = marked_words(data, offsets)
            return self.table.tokens(data, starts, first, b" ")
        raw = data.tobytes()
        ids = [[*self.model.encode(raw[a:b].decode("utf-8", "replace")), self.end] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.array([i for x in ids for i in x], np.int32), np.cumsum([0, *map(len, ids)])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        flat = ids.tolist()
        return self.model.decode([flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])


def encode(docs: DataFrame, model_path: str, decode: bool = False) -> DataFrame:
    """docs with ids (array<int>, with the end id) of the column text, and with decoded, their text, if asked for."""
    model = docs.sparkSession.sparkContext.broadcast(common.vocabulary(model_path))
    ids_name, decoded_name = common.free_name(docs, "ids"), common.free_name(docs, "decoded")

    def run(batches):
        codec = Codec(model.value)
        for batch in batches:
            for part, data, offsets in common.slices(batch, most=SLICE):
                ids, at = codec.encode(data, offsets)
                more = {ids_name: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))}
                if decode:
                    more[decoded_name] = text_array(codec.decode(ids, at))
                yield common.with_columns(part, **more)

    fields = [*docs.schema.fields, T.StructField(ids_name, T.ArrayType(T.IntegerType()))]
    return docs.mapInArrow(run, T.StructType(fields + [T.StructField(decoded_name, T.StringType())] * decode))


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs(doc_id, text)."""
    out = encode(docs.select("doc_id", F.col("text").cast("string").alias("text")), model_path, decode=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.read(spark, sf_dir, "documents"), common.public_vocabulary("piece_bpe_32k.model"))
