import random

import corpus_pipeline
import test_decontaminate
import test_jaccard_join
import test_sentence_pieces
from paperloom.llm import toxicity as tx


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for d in range(150):
        w = [rng.choice(words) for _ in range(rng.choice([8, 60, 200]))]
        if bad := d % 6 == 0:
            w[1:1] = ["Vileword", "vileword"]
        rows.append((d, " ".join(w), "en", "s", 1))
        labels.append((d, 1, int(bad)))
    bench = [(k, " ".join(rng.choice(words) for _ in range(20))) for k in range(5)]
    for d in range(150, 220):
        _, text, *rest = rng.choice(rows)
        w = text.split()
        if d % 3 == 0:
            w[-1] = "changed"
        if d % 7 == 0:
            w[3:3] = bench[d % 5][1].split()
        rows.append((d, " ".join(w), *rest))
    rows += [(300, None, "en", None, None), (301, "", "en", "s", 0), (302, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns

    toxic = {r.doc_id for r in tx.scores(docs, tx.learn(docs, marks, train=tx.train_rows())).where("score >= 0.5").collect()}
    assert len(toxic & {d for d, _, bad in labels if bad}) > 20
    left = {d: t for d, t, *_ in rows if d not in toxic}
    newest = {}
    for d, t in left.items():
        newest[t or ""] = max(d, newest.get(t or "", d))
    left = {d: t for d, t in left.items() if newest[t or ""] == d}
    found = test_jaccard_join.brute([*left.items()])
    left = {d: left[d] for d, n, component in found if component == d}
    judged = {r[0]: r[-1] for r in test_decontaminate.brute([*left.items()], bench)}
    assert any(judged.values())
    left = {d: t for d, t in left.items() if not judged[d]}
    out = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == {d: test_sentence_pieces.brute(t) for d, t in left.items()}
