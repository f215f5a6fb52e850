import random
import re

import duckdb
import numpy as np
import pytest
from paperloom.llm import jaccard_join as jj

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for k, (d, _) in enumerate(rows):
        r = find(k)
        if d is not None and (best.get(r) is None or d < best[r]):
            best[r] = d
    return sorted(((d, len(s), best.get(find(k))) for k, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(spark, rows, **how):
    out = jj.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()
    assert sum(r.kept for r in out) == len({(r.component_id) if r.n_shingles else ("own", r.rid) for r in out})
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice("abcdefgh") * 3
    return " ".join(words)


@pytest.mark.parametrize("family, hash_bits", [(4096, 64), (8, 64), (3, 64), (1024, 6)])
def test_near_copies(spark, monkeypatch, family, hash_bits):
    """Families in many parts with levels above them; hashes of six bits, by which all shingles seem to occur everywhere."""
    monkeypatch.setattr(jj, "WIDE", 2)
    rng = random.Random(family)
    rows = [(1000, None), (1001, ""), (1002, " \t"), (1003, "One two"), (1004, "one TWO"), (1004, "one two"), (1005, "one two three four"), (1006, "A B C D E"), (1007, "a b c d e")]
    for d in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([40, 100, 300]))]
        rows += [(d * 20 + k, edited(rng, base, rng.randrange(0, 8))) for k in range(15)]
    rows += [(2000, " ".join(f"v{i}" for i in range(3000))), (2001, " ".join(f"v{i}" for i in range(3000)) + " more")]
    rng.shuffle(rows)
    assert got(spark, rows, most=family, hash_bits=hash_bits) == brute(rows)


def thue_morse(a, b, times):
    for _ in range(times):
        a, b = a + b, b + a
    return a, b


def test_words_whose_polynomials_agree(spark):
    """Words of 1024 and 2048 bytes that agree in every polynomial with odd base modulo 2**64."""
    rows = []
    for times in (10, 11):
        x, y = thue_morse("a", "b", times)
        rows += [(100 * times + 1, x), (100 * times + 2, y), (100 * times + 3, f"one two {x} four five"), (100 * times + 4, f"one two {y} four five")]
        tail = " ".join(f"w{i}" for i in range(40))
        rows += [(100 * times + 5, f"{tail} {x}"), (100 * times + 6, f"{tail} {y}"), (100 * times + 7, f"{' '.join([x] * 9)} {tail[:60]}"), (100 * times + 8, f"{' '.join([y] * 9)} {tail[:60]}")]
    assert got(spark, rows) == brute(rows)


def test_shingles_with_one_hash_count_as_two():
    """All hashes equal: a document's distinct shingles are still told apart, and repeated ones count once."""
    import pyarrow as pa

    texts = ["a b c d e f g a b c d e f g", "x y z", "", "a b c d e a b c d e a b c d e", None]
    token, doc, rows = jj.pairs_of_table(pa.table({"text": texts}), 0)
    assert rows == 5 and set(token.tolist()) <= {0}
    assert np.bincount(doc, minlength=5).tolist() == [n for _, n, _ in brute([(0, texts[0])])] + [1, 0, 5, 0]


def test_byte_hashes_tell_spans_apart():
    from paperloom.llm import common

    rng = random.Random(5)
    words = sorted({bytes(rng.choice(b"ab") for _ in range(n)) for n in range(1, 140) for _ in range(40)} | {x.encode() for t in range(1, 12) for x in thue_morse("a", "b", t)})
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(x) for x in words])
    starts = ends - [len(x) for x in words]
    hashes = common.byte_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(words)
    shifted = common.byte_hashes(np.concatenate([np.zeros(3, np.uint8), data]), starts + 3, ends + 3)
    assert (hashes == shifted).all()


def test_named_sets_are_exact():
    rng = random.Random(8)
    texts = list({" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))): 0 for _ in range(60)})
    sets, text, bit = jj.named_sets([x.encode() for x in texts])
    words = [x.split() for x in texts]
    real = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} for w in words]
    for i in range(len(texts)):
        assert len(sets[i]) == len(real[i])
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(real[i] & real[j])
    assert len(bit) == sum(map(len, real)) and np.bincount(text).tolist() == [len(x) for x in real]


def test_very_long_text_and_many_repeated_rows(spark):
    rng = random.Random(2)
    long = [f"w{rng.randrange(100_000)}" for _ in range(200_000)]
    rows = [(1, " ".join(long)), (2, "\t".join(long[:-1])), (3, "W1 " * 150_000)]
    rows += [(4, "the same few words again and again")] * 3000 + [(None, "the same few words again and again")] * 1000 + [(5, "the same few words again and again too")] * 50
    out = jj.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, None: 4}
    assert len(out) == len(rows) and all(r.component_id == want[r.doc_id] for r in out) and sum(r.kept for r in out) == 4


def test_threshold_is_inclusive(spark):
    a = [f"x{i}" for i in range(94)]  # 90 shingles
    rows = [(1, " ".join(a)), (2, " ".join(a[:76])), (3, " ".join(a[:75]))]  # 72 of 90: 0.8 exactly
    assert got(spark, rows) == brute(rows)


def test_empty_and_clashing_columns(spark):
    assert jj.similar_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    names = ["rid", "chunk", "part", "digest", "live", "root"]
    docs = spark.createDataFrame([(2, "a b c d e f", *names), (1, "a b c d e f", *names), (3, "", *names)], ["doc_id", "text", *names])
    out = jj.drop_similar(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_node_bound_never_hides_a_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**24, 200)
    sets = [np.unique(np.concatenate([rng.choice(base, 180, replace=False), rng.integers(0, 2**24, int(rng.integers(0, 60)))])) for _ in range(60)]
    sets.sort(key=len)
    tree = jj.Tree(sets, 1024)
    label = np.arange(len(sets))
    jj.traverse(tree, tree, label, label)
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert label[i] == label[j]


def test_query_matches_brute_force_and_sql(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    out = sorted((tuple(r) for r in jj.op10_jaccard_join(spark, d).collect()), key=str)
    assert out == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert sorted(con.execute(jj.SQL).fetchall(), key=str) == out


@pytest.mark.parametrize("family", [4096, 8])
def test_every_link_is_counted(spark, monkeypatch, family):
    monkeypatch.setattr(jj, "WIDE", 2)
    rng = random.Random(3)
    rows = [(1000, None), (1001, ""), (1002, "One two"), (1003, "one TWO"), (1003, "one two")]
    for d in range(3):
        base = [f"w{rng.randrange(300)}" for _ in range(150)]
        rows += [(d * 40 + k, edited(rng, base, rng.randrange(0, 5))) for k in range(30)]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    similar = lambda x, y: bool(x) and 100 * len(x & y) >= 80 * len(x | y)
    want = sorted((d, len(x), sum(similar(x, y) for y in sets) - bool(x)) for (d, _), x in zip(rows, sets, strict=True))
    assert max(n for _, _, n in want) > 2
    out = jj.link_counts(spark.createDataFrame(rows, "doc_id long, text string"), most=family).collect()
    assert sorted((r.doc_id, r.n_shingles, r.n_links) for r in out) == want


def test_counts_match_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert sorted((tuple(r) for r in jj.op10_jaccard_join_counts(spark, d).collect()), key=str) == sorted(con.execute(jj.SQL_COUNTS).fetchall(), key=str)


def test_parts_of_a_family_do_not_depend_on_tasks(spark, monkeypatch):
    """40 near copies in parts of 16 sets, over 23 partitions: 3 parts, each set in one of them, in order."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(300)}" for _ in range(150)]
    rows = [(k, edited(rng, base, 2)) for k in range(40)]
    docs, rid = jj.common.numbered(spark.createDataFrame(rows, "doc_id long, text string"), "rows")
    members = jj.families(jj.document_sets(docs.withColumnRenamed(rid, "rid")).where("live"))
    assert members.select("root").distinct().count() == 1
    n = members.count()
    for tasks in (1, 23):
        monkeypatch.setattr(jj.common, "shuffle_partitions", lambda _, tasks=tasks: tasks)
        parts = jj.family_parts(members, most=16).orderBy("chunk").collect()
        assert [len(p.digests) for p in parts] == [16] * (n // 16) + [n % 16] * (n % 16 > 0)
        assert len({bytes(d) for p in parts for d in p.digests}) == n
        assert sorted(p.part for p in parts) == sorted({p.part for p in parts})
        assert len(jj.family_parts(members).collect()) == 1


@pytest.mark.parametrize("chunk", [1 << 16, 40, 3])
def test_components_in_chunks(spark, monkeypatch, chunk):
    """Edges contracted in one chunk, in some, and in very many."""
    from paperloom.llm import components as cc

    monkeypatch.setattr(cc, "CHUNK", chunk)
    rng = random.Random(6)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7), (200, 200)]
    up = {x: {x} for e in edges for x in e}
    for a, b in edges:
        if up[a] is not up[b]:
            up[a] |= up[b]
            up.update(dict.fromkeys(up[b], up[a]))
    want = sorted((x, min(mine)) for x, mine in up.items() if len(mine) > 1)
    found = cc.components(spark.createDataFrame(edges * 2, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in found) == want
