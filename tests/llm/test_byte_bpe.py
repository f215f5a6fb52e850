import hashlib
import random

import pyarrow as pa
import pytest
import public_tokenizers as P
import tiktoken
from paperloom.llm import byte_bpe as bb
from paperloom.llm import common

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bb.parse_ranks(common.vocabulary(PATH))
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
D = "/root/testdata/sf0.001"
ODD = ["a", "b", "'", "l", "ll", "re", " ", "  ", "\n", "1", "23", "é", "日", "本", "　", ".", "..", "a" * 40, "\t", "the", "🙂", "\x00", "\U00032a27", "\x1c"]
TEXTS = [None, "", " ", "'", "'ll", "we'll 're", "a" * 999, "ab" * 700, "日本" * 300, "=-" * 300, " " * 501, "\n " * 99, "tie", "tie", "<|endoftext|>"]


def brute(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode_bytes(ids)).hexdigest()


@pytest.fixture(scope="module")
def codec():
    return bb.Codec(RANKS, P.PATTERN, bb.stand_ins(P.PATTERN))


def odd_text(random_, most):
    return "".join(random_.choice(ODD) for _ in range(random_.randint(0, most)))


def test_texts_equal_the_library(codec):
    random_ = random.Random(1)
    texts = [odd_text(random_, 60) for _ in range(3000)]
    ids, at = codec.encode(*common.buffers(pa.array(texts)))
    assert codec.splits and len(codec.table.index) > 100
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [LIBRARY.encode_ordinary(x) for x in texts]
    assert codec.decode(ids, at).to_pylist() == [x.encode() for x in texts]


def test_every_character_is_matched_as_by_the_library(codec):
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in range(0, 0x110000, 64 * 5)]
    ids, at = codec.encode(*common.buffers(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [LIBRARY.encode_ordinary(x) for x in texts]


def test_pieces_of_any_length_equal_direct_merges(codec):
    random_ = random.Random(2)
    for _ in range(2000):
        data = bytes(random_.choice(b"aab \xe3\x81\x82") for _ in range(random_.randint(1, 120)))
        k = random_.randint(0, len(data))
        m = codec.merges
        assert m.halved(data) == m.merged(data) == m.join(m.merged(data[:k]), m.merged(data[k:]))


def test_joins_of_parts(codec):
    random_ = random.Random(3)
    for _ in range(3000):
        text = odd_text(random_, 30)
        cuts = sorted(random_.randint(0, len(text)) for _ in range(random_.randint(1, 4)))
        parts = [codec.encode_part(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        whole, joined = codec.encode_part(text), codec.reduced(parts, bb.REACH)
        assert joined[0].tolist() == whole[0].tolist() == LIBRARY.encode_ordinary(text) and joined[1].tolist() == whole[1].tolist()


def test_tokens_that_no_merge_leads_to():
    ranks = {bytes([k]): k for k in range(256)} | {b"ab": 256, b"abcd": 257}
    codec, library = bb.Codec(ranks, P.PATTERN, {}), tiktoken.Encoding("few", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("abcd", "abcdabcd", "xabcd", "abcdabcd abcd"):
        assert codec.encode_part(text)[0].tolist() == library.encode_ordinary(text)
        for k in range(len(text)):
            assert codec.reduced([codec.encode_part(text[:k]), codec.encode_part(text[k:])], 2)[0].tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("part", [bb.PART, 9, 100])
def test_cases(spark, part):
    rows = list(enumerate(TEXTS * 2))
    out = {r.doc_id: tuple(r)[1:] for r in bb.digests(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), PATH, P.PATTERN, part=part).collect()}
    assert out == {k: brute(t) for k, t in rows}


def test_another_pattern_is_not_cut(spark):
    pattern = r"\w+|\W"
    library = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})
    docs = spark.createDataFrame([(1, "a b-c d_e  f" * 9), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r.ids for r in bb.encode(docs, PATH, pattern, part=3, reach=None).collect()}
    assert out == {1: library.encode_ordinary("a b-c d_e  f" * 9), 2: []}


def test_empty_and_clashing_columns(spark):
    assert bb.digests(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).collect() == []
    for part in (bb.PART, 2):
        row = bb.encode(spark.createDataFrame([(1, "a bcd", "own", "too", 5)], "doc_id long, text string, ids string, decoded string, rid int"), PATH, P.PATTERN, decode=True, part=part).first()
        assert (row.ids, row.decoded, row.rid, bytes(row.decoded_)) == ("own", "too", 5, b"a bcd") and row.ids_ == LIBRARY.encode_ordinary("a bcd")


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    out = {r.doc_id: tuple(r)[1:] for r in bb.op12_byte_bpe(spark, D).collect()}
    assert out == {k: brute(t) for k, t in docs.items()}
