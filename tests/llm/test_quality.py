import math
import random

import numpy as np
import plain
from paperloom.llm import quality as ql


def corpus(n=500, seed=4):
    rng = random.Random(seed)
    rows, labels = [], []
    for d in range(n):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.choice([20, 150, 400]))]
        if bad := d % 4 == 0:
            at = rng.randrange(max(1, len(w) - 60))
            w[at : at + 60] = [x.upper() + "!!" for x in w[at : at + 60]]
        rows.append((d, " ".join(w)))
        labels.append((d, int(not bad)))
    return rows, labels


def test_learns_and_ignores_held_out_labels(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(d, y, 0) for d, y in labels] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    network = ql.learn(docs, marks, train=ql.train_rows())
    out = {r.doc_id: r.score for r in ql.scores(docs, network).collect()}
    assert np.mean([(out[d] >= 0.7) == bool(y) for d, y in labels]) > 0.97
    turned = marks.withColumn("quality", ql.F.when(ql.train_rows(), ql.F.col("quality")).otherwise(1 - ql.F.col("quality")))
    assert ql.learn(docs, turned, train=ql.train_rows()).pack() == network.pack()


def test_gradients():
    rng = np.random.default_rng(0)
    x, bounds, y = rng.normal(size=(9, ql.WIDTH)), np.array([0, 4, 5, 9]), np.array([1.0, 0.0, 1.0])
    net = ql.Network()

    def loss():
        s = net.forward(x, bounds)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for k, g in net.gradients(x, bounds, y).items():
        at = tuple(rng.integers(0, s) for s in net.p[k].shape)
        net.p[k][at] += 1e-5
        up = loss()
        net.p[k][at] -= 2e-5
        down = loss()
        net.p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_passages_of_many_texts_equal_those_of_each():
    texts = ["", " \n ", "a", "A b! c|d", "word " * 130, "é 1 *** " * 100, " x y z", "\n\n"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    x, bounds = ql.passages(data, offsets)
    assert bounds.tolist() == np.concatenate([[0], np.cumsum([max(1, -(-len(t.split()) // 64)) for t in texts])]).tolist()
    for k, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        alone, _ = ql.passages(raw, np.array([0, len(raw)]))
        assert np.allclose(alone, x[bounds[k] : bounds[k + 1]])


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "x" * 100_000), (4, "x" * 100_000), (5, "word " * 60_000), (None, "a b")]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, label string")
    net = ql.Network()
    out = ql.scores(docs, net).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert ql.scores(docs.limit(0), ql.learn(docs, nothing)).collect() == []
    one = ql.learn(docs, spark.createDataFrame([(4, 1)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in ql.scores(docs, one).collect())


def test_names_of_columns_are_free(spark):
    docs = spark.createDataFrame([(1, "a", "own")], "doc_id long, text string, score string")
    out = ql.scores(docs, ql.Network())
    assert out.columns == [*docs.columns, "score_"] and out.first().score == "own"


def plain_passages(text):
    words, raw = plain.spaced(text)
    lower = [w.lower() if w.isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w, _ in words]
    heads = [0, *(start for _, start in words[64::64])]
    out = []
    for k, (a, b) in enumerate(zip(heads, [*heads[1:], len(raw)], strict=True)):
        x, body = [0.0] * ql.WIDTH, raw[a:b]
        for j, kind in enumerate(ql.KINDS):
            x[j] = sum(c in kind for c in body) / max(1, len(body))
        mine = range(64 * k, min(64 * k + 64, len(words)))
        if n := len(mine):
            lengths = [len(lower[i]) for i in mine]
            mean = sum(lengths) / n
            repeats = lambda gap: sum(i >= gap and lower[i] == lower[i - gap] for i in mine) / n  # noqa: B023, E731
            spread = math.sqrt(max(0, sum(v * v for v in lengths) / n - mean**2))
            x[len(ql.KINDS) : len(ql.KINDS) + 8] = [
                mean / 10, spread / 10, repeats(1), repeats(2), len({lower[i] for i in mine}) / n,
                sum(words[i][0][0] in ql.KINDS[0] for i in mine) / n, sum(v == 1 for v in lengths) / n, n / 64,
            ]
            for i in mine:
                h = plain.word_hash(lower[i])
                x[len(ql.KINDS) + 8 + (h >> 40) % 32] += (1 if h >> 63 else -1) / math.sqrt(n)
        out.append(x)
    return np.array(out, np.float32)


def plain_score(net, x):
    p, rows = net.p, []
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    for v in (x - net.mean) / net.scale:
        h = [math.tanh(sum(v * p["w"][:, j]) + p["b"][j]) for j in range(ql.HIDDEN)]
        gate = [math.tanh(sum(np.array(h) * p["v"][:, j]) + p["v0"][j]) * sigmoid(sum(np.array(h) * p["u"][:, j]) + p["u0"][j]) for j in range(ql.ATTENTION)]
        rows.append((math.exp(sum(g * a for g, a in zip(gate, p["a"], strict=True))), h))
    whole = sum(e for e, _ in rows)
    z = [sum(e / whole * h[j] for e, h in rows) for j in range(ql.HIDDEN)]
    return sigmoid(sum(a * b for a, b in zip(z, p["c"], strict=True)) + p["c0"][0])


def test_query_matches_brute_force(spark):
    """Passages, sample and scores once more, one by one, over a whole table; gradients have a test of their own."""
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect() if plain.remainder(r.doc_id, 4) != 2}
    bags = {i: plain_passages(t) for i, t in texts.items()}
    learned = plain.sample(texts, marks, 8000)
    net = ql.Network().fit([bags[i] for i in learned], np.array([marks[i] for i in learned], np.float64))
    out = ql.op3_quality(spark, d).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        assert abs(r.score - plain_score(net, bags[r.doc_id])) < 1e-3 and r.held_out == (plain.remainder(r.doc_id, 4) == 2) and r.predicted == (r.score >= 0.7)
