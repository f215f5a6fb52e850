import hashlib
import random
import re

import pytest
from paperloom.llm import decontaminate as dc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(docs, bench):
    windows = {}
    for i, t in bench:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    items |= windows[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(spark, docs, bench):
    out = dc.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("group", [8 << 20, 300])
def test_cases(spark, monkeypatch, group):
    monkeypatch.setattr(dc, "GROUP", group)
    rng = random.Random(5)
    vocabulary = ["the", "of", "Und", "été", "x1", "42", "日本", "a", "B"]
    bench = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 12, 13, 14, 40])))) for i in range(12, 40)]
    bench = [(i, t + " zz%d" % i if len(t.split()) < 4 else t) for i, t in bench] + [(1, None), (2, ""), (3, "-- !"), (30, bench[5][1]), (None, bench[6][1]), (10, "Same same"), (9, "same  SAME")]
    docs = [(0, None), (1, ""), (2, "..."), (3, bench[3][1]), (3, bench[3][1]), (None, bench[6][1].upper())]
    for d in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([5, 30, 700]))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w))
            w[at:at] = words(rng.choice(bench)[1])
        docs.append((100 + d, rng.choice([" ", "-", "\n", "?! "]).join(w)))
    docs.append((999, "word " * 20000 + " ".join(words(bench[-1][1])) + " word" * 5000))
    assert got(spark, docs, bench) == brute(docs, bench)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a b")]) == []
    assert got(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_clashing_columns(spark):
    bench = spark.createDataFrame([(1, "a b c", "x")], "item_id long, text string, words string")
    docs = spark.createDataFrame([(1, "x a b c", "1", "2", 3), (2, "d", "1", "2", 3)], "doc_id long, text string, items string, `a.hits` string, n_words int")
    out = dc.drop_contaminated(docs, bench)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [2]


def test_query_matches_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    out = sorted(tuple(r) for r in dc.op2_decontaminate(spark, d).collect())
    assert out == sorted(con.execute(dc.SQL).fetchall())
    assert any(r[-1] for r in out)


def test_one_pass_at_a_time(spark, monkeypatch):
    """However many groups the benchmark makes, a plan holds no search, as each is stored, and what all found is put together."""
    monkeypatch.setattr(dc, "GROUP", 40)
    bench = [(k, f"a{k} b{k} c{k} d{k}") for k in range(30)]
    docs = [(k, f"x a{k} b{k} c{k} d{k} y a{29 - k} b{29 - k} c{29 - k} d{29 - k}") for k in range(30)]
    out = dc.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert str(out._jdf.queryExecution().executedPlan()).count("MapInArrow") == 0
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(docs, bench)
