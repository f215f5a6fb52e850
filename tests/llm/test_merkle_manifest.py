import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from paperloom.llm import merkle_manifest as mm
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(digests):
    """The root, and each leaf's (place among its run, siblings) level by level."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    paths = []
    for k in range(len(digests)):
        path = []
        for level in levels[:-1]:
            run = level[k - k % 16 : k - k % 16 + 16]
            path.append((k % 16, run[: k % 16] + run[k % 16 + 1 :]))
            k //= 16
        paths.append(path)
    return levels[-1][0], paths


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for r, path in zip(groups[s], trees[s][1], strict=True):
            tampered = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 == 0 and r[4] is not None
            lowered = r[4].translate(str.maketrans(mm.UPPER, mm.LOWER)) if tampered else r[4]
            digest = leaf((*r[:4], lowered))
            for slot, others in path + top:
                digest = sha("".join([*others[:slot], digest, *others[slot:]]))
            out.append((r[0], leaf(r), trees[s][0], root, sha("".join(x for _, o in path + top for x in o)), digest, digest == root))
    return sorted(out, key=str)


def proofs(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    out = mm.Manifest(mm.leaves(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.translate("text", mm.UPPER, mm.LOWER))).proofs()
    return sorted((tuple(r) for r in out.collect()), key=str)


def row(k, source, text="Some Text"):
    return k, source, "en", 3, text


CASES = {
    "one leaf": [row(1, "a")],
    "one group, a run": [row(k, "a") for k in range(16)],
    "one group, a run and one": [row(k, "a") for k in range(17)],
    "three levels": [row(k, "hot") for k in range(16 * 16 + 3)] + [row(1000, "x")],
    "many groups": [row(k, f"s{k % 41}", f"T{k}") for k in range(400)],
    "order of groups": [row(1, "é"), row(2, "z"), row(3, None), row(4, ""), row(5, "Z"), row(6, "\U00010000"), row(7, "￿")],
    "nulls": [(None, None, None, None, None), (None, "a", None, 2, "X"), (5, "a", "l", None, None), (10, "a", "", 0, "")],
    "repeats": [row(7, "a")] * 20 + [row(7, "a", "other")] * 3 + [row(None, "a")] * 2,
}


@pytest.mark.parametrize("case", CASES)
def test_cases(spark, case):
    assert proofs(spark, CASES[case]) == brute(CASES[case])


def test_groups_across_partitions(spark, monkeypatch):
    monkeypatch.setattr(mm, "TASK_ROWS", 7)
    rows = [row(k, "hot" if k % 3 else f"s{k % 5}", f"Text {k}") for k in range(300)]
    assert proofs(spark, rows) == brute(rows)


def test_empty(spark):
    found = mm.Manifest(mm.leaves(spark.createDataFrame([], SCHEMA)))
    assert found.root is None and found.proofs().collect() == [] and found.nodes().collect() == []


def test_nodes_and_columns(spark):
    docs = spark.createDataFrame([(*row(k, "a"), "x") for k in range(40)], SCHEMA + ", tampered string")
    found = mm.Manifest(mm.leaves(docs))
    levels = {k: n for k, n in found.nodes().groupBy("level").count().collect()}
    assert levels == {0: 40, 1: 3, -1: 1}
    assert all(r.verified for r in found.proofs().collect())


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    found = con.execute(mm.SQL)
    names = [x[0] for x in found.description]
    df = mm.op13_merkle_manifest(spark, D)
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(r[c] for c in names) for r in df.collect())
    assert got == sorted(found.fetchall())
    rows = [tuple(r[c] for c in mm.FIELDS) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in df.collect()), key=str) == brute(rows)
    assert 0 < df.where("NOT verified").count() < 80
