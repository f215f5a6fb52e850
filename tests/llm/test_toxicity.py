import math
import random
import re

import numpy as np
import plain
from paperloom.llm import toxicity as tx


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for d in range(n):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.choice([20, 80, 300]))]
        bad = d % 5 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["Vileword", "vilerthing"])
        rows.append((d, " ".join(w)))
        labels.append((d, int(bad)))
    return rows, labels


def test_learns_and_ignores_held_out_labels(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(d, y, 0) for d, y in labels] + [(None, 1, 0), (5, None, 0)], "doc_id long, toxic int, quality int")
    weights = tx.learn(docs, marks, train=tx.train_rows())
    out = {r.doc_id: r.score for r in tx.scores(docs, weights).collect()}
    assert np.mean([(out[d] >= 0.5) == bool(y) for d, y in labels]) > 0.97
    turned = marks.withColumn("toxic", tx.F.when(tx.train_rows(), tx.F.col("toxic")).otherwise(1 - tx.F.col("toxic")))
    again = tx.learn(docs, turned, train=tx.train_rows())
    assert (again.feature == weights.feature).all() and (again.weight == weights.weight).all()


def test_scores_equal_a_plain_sum(spark):
    rows, labels = corpus(200)
    rows += [(900, None), (901, ""), (902, "vileword " * 30000), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = tx.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    weight = weights.dense()
    out = sorted((r.doc_id, r.score) for r in tx.scores(docs, weights).collect())
    want = []
    for d, t in rows:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        found = {int(f) for _, kind in tx.features(raw, np.array([0, len(raw)])) for f in kind}
        want.append((d, 1 / (1 + np.exp(-(sum(weight[f] for f in found) + weights.intercept)))))
    assert np.allclose([s for _, s in out], [s for _, s in sorted(want)])
    assert 0 <= min(s for _, s in out) and max(s for _, s in out) <= 1


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x", "y")], "doc_id long, text string, rank string, label string")
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    out = tx.drop_toxic(docs, nothing)
    assert out.columns == docs.columns and out.count() == 1
    assert tx.drop_toxic(docs.limit(0), nothing).collect() == []
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert 0 <= tx.scores(docs, tx.learn(docs, one)).first().score <= 1


def test_sample_is_bounded(spark):
    rows, labels = corpus(100)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert tx.labelled_sample(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic", 30, None).count() == 30


def test_each_id_is_learned_from_once_and_within_bytes(spark):
    rows, labels = corpus(100)
    docs = spark.createDataFrame(rows + [rows[7]] * 300 + [(7, "~ another text")], "doc_id long, text string")
    marks = spark.createDataFrame(labels + [labels[7]] * 50 + [(3, 1)], "doc_id long, toxic int")
    out = tx.labelled_sample(docs, marks, "toxic", 1000, None).collect()
    text = dict(rows)
    assert sorted((r.label, r.text) for r in out) == sorted((1 if d == 3 else y, text[d]) for d, y in labels)
    some = tx.labelled_sample(docs, marks, "toxic", 1000, None, most_bytes=5000).collect()
    order = sorted(out, key=lambda r: r["rank"])
    assert sorted(some, key=lambda r: r["rank"]) == order[: len(some)]
    assert sum(len(r.text) for r in order[: len(some) - 1]) < 5000 <= sum(len(r.text) for r in order[: len(some)])


def test_names_of_columns_are_free(spark):
    docs = spark.createDataFrame([(1, "a", "own", "x")], "doc_id long, text string, score string, `_toxicity` string")
    nothing = tx.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    out = tx.scores(docs, nothing)
    assert out.columns == [*docs.columns, "score_"] and out.first().score == "own"
    assert tx.drop_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect() == docs.collect()


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(plain.LOWER))
    hashes = [plain.word_hash(w.encode()) for w in words]
    out = set(hashes) | {plain.word_hash(w.encode()[:n]) ^ n << 56 for w in words for n in (4, 5)}
    for gap in (1, 2):
        out |= {plain.mix((a * 0xD6E8FEB86659FD93 + b + gap) & plain.M) for a, b in zip(hashes, hashes[gap:])}
    return {h >> 44 for h in out}


def plain_fit(texts, marks):
    z, n = {}, {}
    positive = sum(marks)
    intercept, total = math.log((positive + 0.1) / (len(marks) - positive + 1)), 1.0
    weight = lambda f: 0.0 if abs(z.get(f, 0.0)) <= 8 else (math.copysign(8, z[f]) - z[f]) / (1 + math.sqrt(n[f]))
    for _ in range(8):
        for features, y in zip(texts, marks, strict=True):
            w = {f: weight(f) for f in features}
            g = 1 / (1 + math.exp(-max(-35, min(35, intercept + sum(w.values()))))) - y
            for f in features:
                old = n.get(f, 0.0)
                n[f] = old + g * g
                z[f] = z.get(f, 0.0) + g - (math.sqrt(n[f]) - math.sqrt(old)) * w[f]
            total += g * g
            intercept -= g / (1 + math.sqrt(total))
    return {f: weight(f) for f in z}, intercept


def test_query_matches_brute_force(spark):
    """Features, learning and scores once more with dictionaries, over a whole table."""
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect() if plain.remainder(r.doc_id, 5) != 0}
    features = {i: plain_features(t) for i, t in texts.items()}
    learned = plain.sample(texts, marks, 10_000)
    weights, intercept = plain_fit([features[i] for i in learned], [marks[i] for i in learned])
    out = tx.op7_toxicity(spark, d).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts) and any(r.predicted for r in out)
    for r in out:
        want = 1 / (1 + math.exp(-(intercept + sum(weights.get(f, 0.0) for f in features[r.doc_id]))))
        assert abs(r.score - want) < 1e-6 and r.held_out == (plain.remainder(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.5)
