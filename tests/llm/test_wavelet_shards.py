import zlib

import numpy as np
import pytest
from paperloom.llm import common
from paperloom.llm import wavelet_shards as ws
from tokenizers import Tokenizer

PATH = common.public_vocabulary("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  ", "a  b", "don't  we'll 'S", "x  y", "é à ñ", "日本 語 🙂  z", "a\n\n b \t c", "<|endoftext|> a <|endoftext|>b  <|endoftext|>", "1234 5 a1b2", "x" * 4000, "the cat " * 900,
    "  a", "á b", "я b", "a\u0085 b", "\x1f b \x7f c",
]


def brute(rows):
    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(spark, rows, tmp_path, columns=()):
    docs = spark.createDataFrame([(*r, *columns) for r in rows], "doc_id long, text string" + "".join(f", {c} string" for c in columns)).repartition(3)
    shards = ws.write_shards(docs, PATH, 2, f"file://{tmp_path}/shards")
    out = ws.read_documents(shards).join(ws.shard_starts(shards), ["part", "shard"])
    return sorted((r.doc_id, r.before + r.offset, r.n_tokens, r.ids_crc32) for r in out.collect()), shards


@pytest.mark.parametrize("shard", [1 << 19, 50])
def test_cases(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(ws, "SHARD", shard)
    rows = list(enumerate(TEXTS * 3))
    out, shards = got(spark, rows, tmp_path, ["part", "shard", "ends"])
    assert out == brute(rows)
    tokenizer = Tokenizer.from_file(PATH)
    for row in shards.limit(4).collect():
        shard = ws.Shard(row.asDict())
        tokens = np.concatenate([[*tokenizer.encode(dict(rows)[d] or "", add_special_tokens=False).ids, 2] for d in shard.doc_ids])
        assert (shard.tokens() == tokens).all()
        for at in range(0, len(tokens), 7):
            assert shard.token(at) == tokens[at]
            assert shard.count(int(tokens[at]), at) == (tokens[:at] == tokens[at]).sum()
        for token in np.unique(tokens)[:5].tolist():
            assert [shard.occurrence(token, k) for k in range(shard.count(token))] == np.flatnonzero(tokens == token).tolist()
        assert shard.count(50000) == 0


def test_ties_and_null_ids(spark, tmp_path):
    out, _ = got(spark, [(1, "a b"), (1, "a b"), (2, "c"), (2, "c")], tmp_path)
    assert out == brute([(1, "a b"), (1, "a b"), (2, "c"), (2, "c")])
    shards = ws.write_shards(spark.createDataFrame([(5, "x"), (None, "y z")], "doc_id long, text string"), PATH, 2, f"file://{tmp_path}/nulls")
    assert [d for r in shards.orderBy("part", "shard").collect() for d in r.doc_ids] == [None, 5]


def test_empty(spark, tmp_path):
    assert got(spark, [], tmp_path)[0] == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    assert sorted(tuple(r) for r in ws.op1_wavelet_shards(spark, d).collect()) == brute(rows)


def test_other_patterns_are_encoded_whole(spark, tmp_path):
    """A tokenizer that splits texts otherwise."""
    path = common.public_vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [t for t in TEXTS if t and "<|" not in t] + ["Don't STOP it's a1b2 no.more,please"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shards = ws.write_shards(docs, path, 2, f"file://{tmp_path}/words")
    got = {r.doc_id: r.ids_crc32 for r in ws.read_documents(shards).collect()}
    assert got == {k: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for k, t in enumerate(texts)}
