import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from paperloom.llm import common
from paperloom.llm import subword_lm as lm

PATH = common.public_vocabulary("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1


def logadd(a, b):
    return max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)


def lattice(word, weight, longest, expected=None, times=1):
    """Plain forward (and backward) recursion over one word."""
    raw = b" " + word.encode()
    n = len(raw)
    edges = [(i, j, raw[i:j]) for j in range(1, n + 1) for i in range(max(0, j - longest), j) if raw[i:j] in weight]
    f = [0.0] + [-math.inf] * n
    for i, j, p in edges:
        f[j] = logadd(f[j], f[i] + math.log(weight[p]))
    if expected is not None:
        b = [-math.inf] * n + [0.0]
        for i, j, p in sorted(edges, key=lambda e: (-e[0], -e[1])):
            b[i] = logadd(b[i], b[j] + math.log(weight[p]))
        for i, j, p in edges:
            expected[p] += times * math.exp(f[i] + math.log(weight[p]) + b[j] - f[n])
    return f[n]


def brute(rows):
    first = lm.Pieces.load(common.vocabulary(PATH))
    longest = max(map(len, first.texts))
    weight = dict(zip(first.texts, first.weights, strict=False))
    count, docs = Counter(), 0
    for d, t in rows:
        if not held(d):
            count.update(tokens(t))
            docs += 1
    n, v = sum(count.values()) + docs, len(count) + (docs > 0)
    new = weight
    for _ in range(lm.ROUNDS):
        expected = Counter()
        for w, c in count.items():
            lattice(w, new, longest, expected, c)
        new = {p: expected[p] + lm.PRIOR * w for p, w in weight.items()}
        end = docs + lm.PRIOR * first.weights[-1]
        total = sum(new.values()) + end
        new = {p: w / total for p, w in new.items()}
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    memo = {}
    out = []
    for d, t in rows:
        w = tokens(t)
        for x in w:
            if x not in memo:
                memo[x] = lattice(x, new, longest) / math.log(10)
        out.append((d, held(d), len(w) + 1, sum(count[x] > 0 for x in w) + (docs > 0), n, sum(base(count[x]) for x in w) + base(docs), sum(memo[x] for x in w) + math.log10(end / total)))
    return sorted(out, key=lambda r: (str(r[0]), r[2], r[6]))


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, chunk string").repartition(3)
    out = sorted((tuple(r) for r in lm.lattice_scores(docs, lm.held_out_rows(), PATH).collect()), key=lambda r: (str(r[0]), r[2], r[6]))
    want = brute(rows)
    assert [r[:5] for r in out] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in out], [r[5:] for r in want], rtol=1e-9)


def test_cases(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 500)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "The the THE cat"), (4, "The the THE cat"), (None, "null id"), (5, "É été 日本語 🙂"), (6, "x" * 300), (7, "ab" * 40 + " x"), (8, "▁a a▁b"), (9, "word " * 2000)]
    rows += [(100 + k, f"some words{k % 7} repeat often, {'rare' + str(k)} other") for k in range(60)]
    check(spark, rows)


def test_no_training_rows_and_empty(spark):
    some = [(d, f"only held out {d}") for d in range(200) if held(d)][:5]
    check(spark, some)
    assert lm.lattice_scores(spark.createDataFrame([], "doc_id long, text string"), lm.held_out_rows(), PATH).collect() == []


def test_weights_are_a_distribution():
    pieces = lm.Pieces.load(common.vocabulary(PATH))
    assert abs(pieces.weights.sum() - 1) < 1e-9 and (pieces.weights > 0).all()
    short = lm.Pieces([b" ", b"a", b"b", b"ab", b" a"], np.array([0.2, 0.2, 0.2, 0.1, 0.1, 0.2]))
    data = np.frombuffer(b"ab", np.uint8)
    got = math.exp(lm.Lattice(short).words(data, np.array([0]), np.array([2]))[0])
    assert abs(got - (0.2 * 0.2 * 0.2 + 0.2 * 0.1 + 0.1 * 0.2)) < 1e-12
    assert abs(math.exp(lm.Lattice(short)._one(np.frombuffer(b" ab", np.uint8), 0, None)) - got) < 1e-12


def test_better_than_the_first_weights(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    out = {r.doc_id: r for r in lm.op6_subword_lm(spark, d).collect()}
    assert len(out) == len(rows)
    first = lm.Pieces.load(common.vocabulary(PATH))
    lattice_ = lm.Lattice(first)
    plain = 0.0
    for i, t in rows:
        if held(i):
            data, offsets = common.buffers(pa.array([" ".join(tokens(t))]))
            starts, ends, _ = common.word_spans(data, offsets, common.NONSPACE)
            plain += lattice_.words(data, starts, ends - starts).sum() / math.log(10) + math.log10(first.weights[-1])
    assert sum(r.score for r in out.values() if r.held_out) > plain


def test_query_equals_brute_force(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").where("n_chars < 900").coalesce(2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = sorted((tuple(r) for r in lm.op6_subword_lm(spark, str(tmp_path)).collect()), key=lambda r: (str(r[0]), r[2], r[6]))
    want = brute(rows)
    assert len(rows) > 40 and [r[:5] for r in out] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in out], [r[5:] for r in want], rtol=1e-9)


def test_vectors_are_added_by_a_tree(spark):
    import numpy as np
    from paperloom.llm import subword_lm

    rows = [(k, k + 1, 1, bytearray(np.array([float(k), 1.0]).tobytes())) for k in range(0, 50, 3)]
    out = subword_lm.added(spark.createDataFrame(rows, subword_lm.SUMS), 50, fan=3).collect()
    assert len(out) <= 3 and sum(r.tokens for r in out) == sum(r[1] for r in rows) and sum(r.words for r in out) == len(rows)
    assert sum(np.frombuffer(bytes(r.expected)) for r in out).tolist() == [float(sum(r[0] for r in rows)), float(len(rows))]
