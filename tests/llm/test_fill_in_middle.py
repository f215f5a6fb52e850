import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from paperloom.llm import common
from paperloom.llm import fill_in_middle as fim
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"
TEXTS = [None, "", "a", "é", "日本語のテキスト", "🙂🙂🙂", "has <P> in it", "<S>", "<M", "< P>", "plain words in a row\nand a line\n", "x" * 9000, "é🙂" * 5000, "a\x00b", " ", "  two  spaces ", "tie", "tie"]


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in fim.CONTROLS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("long, chunk", [(fim.LONG, fim.LONG_CHUNK), (4, 7), (100, 64)])
def test_cases(spark, long, chunk):
    rows = [(k if k % 7 else None, t) for k, t in enumerate(TEXTS * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = fim.fill_in_middle(docs, long=long, long_chunk=chunk).withColumn("restored", fim.restore(F.col("output"), F.col("form")))
    got = sorted(((r.doc_id, r.text, r.units, r.form, r.prefix_units, r.middle_units, r.output) for r in out.collect()), key=str)
    assert got == sorted(((d, t, *brute(d, t)) for d, t in rows), key=str)
    assert all(r.restored == (r.text or "") for r in out.collect())
    for r in out.where("form <> 'plain'").collect():
        raw = r.text.encode()
        assert len(raw[: r.prefix_bytes].decode()) == r.prefix_units and len(raw[r.prefix_bytes :][: r.middle_bytes].decode()) == r.middle_units


@pytest.mark.parametrize("units, parts", [("lines", lambda t: t.split("\n")), ("words", None)])
def test_other_units_cut_only_at_their_borders(spark, units, parts):
    texts = ["one two  three\nfour", "\n\na\n", "word", " lead and trail ", "é à\nß 日 本\n" * 40]
    docs = spark.createDataFrame(list(enumerate(texts * 20)), "doc_id long, text string")
    for long, chunk in ((fim.LONG, fim.LONG_CHUNK), (2, 5)):
        for r in fim.fill_in_middle(docs, units, long=long, long_chunk=chunk).where("form <> 'plain'").collect():
            raw = r.text.encode()
            starts = [k for k in range(len(raw)) if k == 0 or (raw[k - 1] == 10 if units == "lines" else raw[k - 1] in b" \n" and raw[k] not in b" \n")]
            assert r.units == len(starts)
            for at in (r.prefix_bytes, r.prefix_bytes + r.middle_bytes):
                assert at in (*starts, len(raw))


def test_only_owning_chunks_are_scanned_again(monkeypatch):
    data, offsets = common.buffers(pa.array(["é" * 1000, "", "ab" * 700]))
    sizes = []
    real = fim._starts
    monkeypatch.setattr(fim, "_starts", lambda w, *a: sizes.append(len(w) - 1) or real(w, *a))
    units, ranks, places = fim.cut(data, offsets, np.array([[3, 999], [5, 6], [0, 1400]]), fim.UNITS["characters"], 64)
    assert units.tolist() == [1000, 0, 1400] and places.tolist() == [[6, 1998], [0, 0], [0, 1400]]
    assert sizes[0] == len(data) and len(sizes) == 4 and max(sizes[1:]) <= 64


def test_empty_clashing_and_bad_controls(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    row = fim.fill_in_middle(spark.createDataFrame([(3, "abc", "o", 1, "d")], "doc_id long, text string, output string, units int, _draws string")).first()
    assert (row.output, row.units, row._draws, row.units_) == ("o", 1, "d", 3) and row.output_
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "b", "c"), ("xa", "ay", "z"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), controls=bad)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    found = con.execute(fim.SQL)
    names = [x[0] for x in found.description]
    df = fim.op11_fill_in_middle(spark, D)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(found.fetchall())
