import hashlib
from itertools import product

import pyarrow as pa
import sentencepiece
from paperloom.llm import common
from paperloom.llm import sentence_pieces as sp

PATH = common.public_vocabulary("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   ", "a", " a", "  a", "a ", "a  b   c", "▁", "a▁b", "▁a", " ▁a", "▁ a ▁▁b", "line\nnext  line\r\n\ttab", "É à ß 日本語 🙂 \x00 x", "a b　c",
    "<s> </s> <unk> <0x0A>", "the " * 3000, "x" * 5000, "The the The", "日 本", "fin x y",
]


def brute(text):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = [*model.encode(text or ""), 2]
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_cases(spark):
    rows = list(enumerate(TEXTS * 2))
    out = {r.doc_id: tuple(r)[1:] for r in sp.digests(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), PATH).collect()}
    assert out == {k: brute(t) for k, t in rows}


def test_table_is_used_and_equals_the_library_on_all_short_texts():
    texts = ["".join(x) for n in range(6) for x in product("a \n\x00▁", repeat=n)]
    texts += ["".join(x) for n in range(4) for x in product(["ab", "  ", "\t", "é", "日", "🙂", "<s>", "\r\n", "　", "▁▁", "."], repeat=n)]
    codec = sp.Codec(common.vocabulary(PATH))
    ids, at = codec.encode(*common.buffers(pa.array(texts)))
    assert codec.splits and len(codec.table.index) > 1000
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*x, 2] for x in codec.model.encode(texts)]


def test_table_is_joined_back():
    """A word's entry decides its ids at all of its places."""
    codec = sp.Codec(common.vocabulary(PATH))
    codec.encode(*common.buffers(pa.array(["some words"])))
    codec.table.flat[codec.table.starts[codec.table.index[b" words"]]] = 5
    ids, at = codec.encode(*common.buffers(pa.array(["some words and words", "other words"])))
    assert (ids == 5).sum() == 3


def test_table_of_one_slice_may_be_larger_than_its_limit():
    codec = sp.Codec(common.vocabulary(PATH))
    codec.table.most = 2
    assert codec.splits
    data, offsets = common.buffers(pa.array(["a b c d e f", "e f g"]))
    ids, at = codec.encode(data, offsets)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*codec.model.encode(x), 2] for x in ("a b c d e f", "e f g")]


def test_empty_and_clashing_columns(spark):
    assert sp.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    docs = spark.createDataFrame([(1, "a b", "x", None)], "doc_id long, text string, chunk string, start long")
    assert [r.asDict() for r in sp.encode(docs, PATH).drop("ids").collect()] == [r.asDict() for r in docs.collect()]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = {r.doc_id: tuple(r)[1:] for r in sp.op8_sentence_pieces(spark, d).collect()}
    assert out == {k: brute(t) for k, t in docs.items()}


def test_names_of_columns_are_free(spark):
    docs = spark.createDataFrame([(1, "a b", "own", "too")], "doc_id long, text string, ids string, decoded string")
    row = sp.encode(docs, common.public_vocabulary("piece_bpe_32k.model"), decode=True).first()
    assert (row.ids, row.decoded, row.decoded_) == ("own", "too", "a b") and len(row.ids_) > 1
