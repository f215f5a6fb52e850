import hashlib
from collections import defaultdict

import pytest
from paperloom.llm import exact_dedup as ed
from pyspark.sql import functions as F


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    return sorted(
        ((d, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows), key=str
    )


def check(spark, rows):
    out = ed.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == brute(rows)
    assert sum(r.kept for r in out) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_cases(spark):
    long = "é" * 5000 + "x" * 30000
    rows = [(1, None), (2, ""), (3, "a"), (4, "a"), (4, "a"), (None, "a"), (None, None), (5, long), (6, long), (7, long + "y"), (8, "y" + long), (9, long[:4096]), (10, "a "), (4, "b")]
    check(spark, rows)


def test_blocks_shared_by_many(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 4)
    rows = [(i, ("same" * 3 if i % 3 else "same" * (i % 7)) + ("" if i % 2 else str(i % 50))) for i in range(2000)]
    check(spark, rows)


def test_empty(spark):
    assert ed.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_clashing_columns(spark):
    names = ["rid", "n", "pos", "sha", "name", "block", "hash"]
    docs = spark.createDataFrame([(1, "a", *"1234567"), (2, "a", *"1234567"), (3, "b", *"1234567")], ["doc_id", "text", *names])
    out = ed.drop_exact_duplicates(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 3]


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_matches_sql(spark, sf):
    import duckdb

    d = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = sorted(con.execute(ed.SQL).fetchall())
    got = sorted(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in ed.op9_exact_dedup(spark, d).collect())
    assert got == want


def test_rows_keep_their_numbers_over_shuffles(spark):
    """After a shuffle a row may get another number each time it is computed; exactly one of each text must stay."""
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 40).cast("string")).alias("text"), F.rand().alias("x"))
    out = ed.drop_exact_duplicates(rows.repartition(13).orderBy(F.rand()))
    assert sorted(r.doc_id for r in out.collect()) == list(range(560, 600))


def test_repeated_and_null_ids_match_sql(spark, tmp_path):
    import duckdb

    rows = [(1, "a"), (1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, ""), (2, None), (3, "c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((tuple(r) for r in ed.op9_exact_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(con.execute(ed.SQL).fetchall(), key=str)


def test_buckets_follow_the_blocks(spark, monkeypatch):
    assert ed._buckets(spark, 0) == 32 and ed._buckets(spark, 1 << 30) == 1 << 15
    monkeypatch.setattr(ed, "BUCKET", 2)
    rows = [(k, "x" * (k % 50 + 1) * 300) for k in range(400)] + [(1000 + k, "same") for k in range(700)]
    found = ed.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    last = {}
    for d, t in rows:
        last[t] = max(d, last.get(t, 0))
    assert {r.doc_id: r.keep_id for r in found} == {d: last[t] for d, t in rows}
