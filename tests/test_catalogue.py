import random
import re
from collections import Counter
from datetime import date

import numpy as np
import pyarrow as pa
import pytest
from paperloom.functions.text import parts_of, words, words_of_rows
from paperloom.operators import bibliography, features, trees
from paperloom.plans import builtin
from paperloom.plans import report as reports
from paperloom.schemas import Corpus, text_table, texts
from paperloom.sources import databases, stored
from pyspark.sql import functions as F


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def near(a, b):
    if not a or not b:
        return False
    x, y = set(a.split()), set(b.split())
    return bool(x & y) and len(x - y) <= 1 and len(y - x) <= 1 and distance(a, b) <= 3


def look_up(asked, works, strict):
    out = {}
    for n, title, source in asked:
        got = None
        for text in [] if title is None else [title, title.split(":")[0].strip()] if ":" in title else [title]:
            rungs = [[], [], []]
            plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
            close = {w: distance(plain(text), plain(t)) for w, t, _ in works if t is not None and near(plain(text), plain(t))}
            for w, t, s in works:
                same = source is not None and s is not None and source.lower() == s.lower()
                if t is not None and t.lower() == text.lower():
                    rungs[1].append((1, w))
                    if same:
                        rungs[0].append((0, w))
                if w in close and close[w] == min(close.values()):
                    rungs[2].append((0 if same else 1, w))
            k = next((k for k, r in enumerate(rungs) if r), None)
            if k is not None:
                got = (min(rungs[k])[1], bibliography.RUNGS[k]) if not strict or k == 0 and len(rungs[0]) == 1 else None
                break
        out[n] = got or (None, None)
    return out


@pytest.mark.parametrize("strict", [True, False])
def test_look_up_equals_brute_force(spark, strict):
    rng = random.Random(4)
    vocabulary = ["the", "of", "a", "effect", "effects", "study", "mind", "minds", "social", "on", "x1", "x2", "rare", "case"]
    title = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6)))
    works = [(k, title(), rng.choice(["J", "K", None])) for k in range(150)] + [(1000, None, "J"), (1001, "", "J"), (1002, "Twice", "J"), (1003, "twice", "j"), (1004, "Twice", "K")]
    asked = [(k, rng.choice(works[:150])[1], rng.choice(["J", "k", None])) for k in range(60)]
    asked += [(100 + k, t.replace("e", "", 1).upper(), "J") for k, (_, t, _) in enumerate(works[:40])] + [(200 + k, f"{t} : and more of it", s) for k, (_, t, s) in enumerate(works[:40])]
    asked += [(300, None, "J"), (301, "", "J"), (302, "Twice", "J"), (303, "TWICE", "K"), (304, "nothing like it", None), (305, ": x", "J"), (306, "twice", None)]
    rows = bibliography.look_up(spark.createDataFrame(asked, "n long, title string, source string"), spark.createDataFrame(works, "work long, title string, source string"), strict).collect()
    assert {r.n: (r.work, r.match) for r in rows} == look_up(asked, works, strict) and len(rows) == len(asked)


def test_near_titles_are_only_searched_for_what_is_open(spark, monkeypatch):
    """Titles of two words with one in common are near to very many; those found already, or that strictness leaves out, are not looked for."""
    searched = []
    near_titles = bibliography.near_titles
    monkeypatch.setattr(bibliography, "near_titles", lambda asked, *more: searched.append(asked.count()) or near_titles(asked, *more))
    works = spark.createDataFrame([(k, f"Customer {k:09}", "J") for k in range(200)], "work long, title string, source string")
    asked = spark.createDataFrame([(k, f"CUSTOMER {k:09}", "j" if k % 2 else "K") for k in range(100, 300)], "n long, title string, source string")
    strict = {r.n: r.work for r in bibliography.look_up(asked, works).collect()}
    assert strict == {k: k if k < 200 and k % 2 else None for k in range(100, 300)} and not searched
    loose = {r.n: r.match for r in bibliography.look_up(asked, works, strict=False).collect()}
    assert loose == {k: ("both" if k % 2 else "title") if k < 200 else "near" for k in range(100, 300)} and searched == [100]


def test_look_up_of_nothing(spark):
    none, one = spark.createDataFrame([], "n long, title string, source string"), spark.createDataFrame([(1, "a b", "J")], "n long, title string, source string")
    assert bibliography.look_up(none, one.withColumnRenamed("n", "work")).collect() == []
    assert [tuple(r) for r in bibliography.look_up(one, none.withColumnRenamed("n", "work"), False).collect()] == [(1, None, None)]


def test_dois_of_a_bibliography(spark):
    bib = spark.createDataFrame([("a", "On X", "J", None), ("b", "On X", "J", "10.1/own"), ("c", "On X", None, ""), ("d", None, "J", None), ("e", "On X", "J", None)], "xref_id string, title string, journal string, doi string")
    works = spark.createDataFrame([("10.2/x", "on x", "j"), ("", "on y", "j")], "doi string, title string, source string")
    assert {r.xref_id: r.doi for r in bibliography.add_dois(bib, works).collect()} == {"a": "10.2/x", "b": "10.1/own", "c": None, "d": None, "e": "10.2/x"}
    assert bibliography.add_dois(bib, works, strict=False).where("xref_id = 'c'").first().doi == "10.2/x"


def below(edges, roots):
    out = {}
    for root in roots:
        now, seen = [(root, None, (root,))], {root}
        for depth in range(len(edges) + 2):
            for node, parent, path in now:
                out[root, node] = (parent, depth, list(path))
            new = {}
            for node, _, path in sorted(now):
                for child in sorted(c for c, p in edges if p == node and c not in seen):
                    if child not in new or node < new[child][1]:
                        new[child] = (child, node, (*path, child))
            seen |= set(new)
            now = list(new.values())
    return out


def test_trees(spark):
    rng = random.Random(1)
    cases = [[(k, k // 3) for k in range(1, 60)], [(k, k - 1) for k in range(1, 9)], [(1, 2), (2, 3), (3, 1), (4, 1), (5, 5)], [(rng.randrange(25), rng.randrange(25)) for _ in range(60)]]
    for edges in cases:
        table = spark.createDataFrame([*edges, (99, None), (None, 3), edges[0]], "id long, parent long")
        roots = [0, 1, 7]
        found = trees.descendants(table, spark.createDataFrame([(r,) for r in [*roots, 0]], "id long")).collect()
        assert {(r.root, r.id): (r.parent, r.depth, list(r.path)) for r in found} == below(set(edges), roots) and len(found) == len(below(set(edges), roots))
    names = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", None)], "id string, parent string")
    assert {r.id: "/".join(r.path) for r in trees.descendants(names).collect()} == {"a": "a", "b": "a/b", "c": "a/b/c"}
    assert {r.id for r in trees.descendants(names, most=1).collect()} == {"a", "b"}
    assert trees.descendants(names.limit(0)).collect() == []
    sums = trees.totals(trees.descendants(names), spark.createDataFrame([("b", 2), ("c", 3)], "id string, size int"), "size")
    assert {r.id: (r.n, r.total) for r in sums.collect()} == {"a": (3, 5), "b": (2, 5), "c": (1, 3)}


def test_snapshots(spark, tmp_path):
    rows = [("a", "x", date(2024, 1, 1)), ("a", "y", date(2024, 2, 1)), ("b", "x", date(2024, 1, 1)), ("c", "z", date(2024, 2, 1)), ("c", "q", date(2024, 2, 1)), (None, "x", date(2024, 1, 1))]
    out = databases.latest(spark.createDataFrame(rows, "doi string, retractionwatch string, date date")).collect()
    assert {tuple(r) for r in out} == {("a", "y", date(2024, 2, 1)), ("b", "x", date(2024, 1, 1)), ("c", "q", date(2024, 2, 1))}
    old, new = (spark.createDataFrame(x, "doi string, kind string") for x in ([("a", "x"), ("b", None), ("c", "x"), ("d", None)], [("a", "x"), ("b", "y"), ("e", None), ("d", None)]))
    assert {(r.doi, r.change) for r in databases.difference(old, new).collect()} == {("b", "changed"), ("c", "removed"), ("e", "added")}
    assert databases.difference(old.limit(0), new.limit(0)).collect() == []


def test_an_update_twice_on_a_day_is_one(spark, tmp_path):
    before = spark.conf.get(databases.FOLDER, None)
    spark.conf.set(databases.FOLDER, str(tmp_path / "db"))
    try:
        for kinds in ("Retraction", "Correction"):
            (tmp_path / "list.csv").write_text(f"OriginalPaperDOI,RetractionNature\n10.1/a,{kinds}\n")
            databases.update_retractions(spark, str(tmp_path / "list.csv"))
        assert [tuple(r) for r in databases.retractions(spark).collect()] == [("10.1/a", "Correction")]
        spark.createDataFrame([("10.1/a", "Retraction", date(2020, 1, 1)), ("10.1/b", "x", date(2020, 1, 1))], databases.RETRACTIONS).write.partitionBy("date").mode("append").parquet(str(tmp_path / "db/retractionwatch"))
        assert databases.retractions(spark).count() == 1
        assert {(r.doi, r.change) for r in databases.retraction_changes(spark, date(2021, 1, 1)).collect()} == {("10.1/a", "changed"), ("10.1/b", "removed")}
        assert {(r.doi, r.change) for r in databases.retraction_changes(spark, date(2019, 1, 1)).collect()} == {("10.1/a", "added")}
    finally:
        spark.conf.unset(databases.FOLDER) if before is None else spark.conf.set(databases.FOLDER, before)


def test_quotes_are_limited_early(spark):
    rows = [("10.1/hot", "t", "w", f"says {k:04}", k) for k in range(300)] + [("10.1/hot", "t", "w", "says 0000", 999), ("10.1/none", "t", "w", None, None), ("10.1/one", None, "w", "x", 1)]
    found = builtin.quotes(spark.createDataFrame(rows, "doi string, reftext string, warning string, text string, s int"))
    assert "WindowGroupLimit" in found._jdf.queryExecution().toString()
    out = sorted((r.doi, r.n, r.place, r.text) for r in found.where("place IS NOT NULL").collect())
    assert out == [("10.1/hot", 301, k + 1, f"says {k:04}") for k in range(5)] + [("10.1/one", 1, 1, "x")]
    assert [(r.doi, r.n, r.text) for r in found.where("place IS NULL").collect()] == [("10.1/none", 0, None)]


def test_reports_of_papers(spark, tmp_path):
    text = [("a/1", "p < .05 | x", 1), ("a/1", "p = n.s.\nso", 2), ("b", "fine", 1), ("c", "This was marginally significant", 1)]
    corpus = Corpus.of(spark, full_text=text_table(spark.createDataFrame(text, "id string, text string, seq long")))
    out = {r.id: r.report for r in reports.paper_reports(corpus, ("exact_p", "marginal", "retractionwatch"), max_rows=1, options={"retractionwatch": {"db": "not a table"}}).collect()}
    assert out["a/1"].startswith("# a/1\n\n## Exact P-Values\n\nShowing 1 of 2 rows\n\n| text | section | div | p | s |\n") and out["b"].count("Nothing found.") == 2
    assert "marginally" in out["c"] and all("This check failed" in x for x in out.values())
    written = reports.write_reports(corpus, str(tmp_path / "out"), ("marginal",)).collect()
    assert {r.name for r in written} == {"a/1_report.md", "b_report.md", "c_report.md"} and (tmp_path / "out/a/1_report.md").read_text().startswith("# a/1\n")
    with pytest.raises((ValueError, LookupError)):
        reports.paper_reports(corpus, ("no such module",))


def test_word_classifier_is_at_its_optimum(spark):
    docs = [(k, f"{'bad' if k % 3 == 0 else 'good'} word{k % 7} and more{' bad' if k % 11 == 0 else ''}", int(k % 3 == 0)) for k in range(90)] + [(200, None, 1), (201, "", 0), (202, "unlabelled rare", None)]
    table = spark.createDataFrame(docs, "doc_id int, text string, label int")
    fitted = features.word_classifier(table, ridge=0.02)
    assert "bad" in fitted.vocabulary and "rare" not in fitted.vocabulary
    weights, bias = np.array([fitted.weights()[w] for w in fitted.vocabulary]), fitted.model.intercept
    rows = [(set(re.findall(r"\w+", t or "")), y) for _, t, y in docs if y is not None]
    x = np.array([[w in words for w in fitted.vocabulary] for words, _ in rows], float)
    y = np.array([v for _, v in rows])
    slope = 1 / (1 + np.exp(-(x @ weights + bias))) - y
    assert np.abs(x.T @ slope / len(y) + 0.02 * weights).max() < 1e-6 and abs(slope.mean()) < 1e-6
    out = {r.doc_id: r for r in fitted.transform(table.withColumn("probability", F.lit("own"))).collect()}
    assert out[0].prediction == 1 and out[1].prediction == 0 and 0 < out[202].probability < 1
    with pytest.raises(ValueError, match="no word"):
        features.word_classifier(table.where("doc_id = 202").withColumn("label", F.lit(1)))


def test_word_vectors_are_of_the_words_that_spark_finds(spark):
    """Every plain character alone and beside what joins words, and texts of others, which Spark takes apart itself."""
    plain = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x20AC]]
    rows = [f"{c} a{c}b a.{c}b 1,{c}2 x{c}'y {c}’z A{c},3" for c in plain] + ["".join(plain), "Ça l'été, ÉTÉ l’été 1,000.5 x,½,y a..b _a_ ,1 ß", None, "", " \n ", "a\n", "\n"]
    rows += ["Ωμέγα ΣΑΣ, σας", "слово 1,٣ й.Й", "漢字,5 平仮名.a", "İstanbul 𝒳𝒴.𝟙 𐓀a", "a\u2028b \ufeffword \U0001f600x"]
    rows *= 2
    table = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(rows)], "n int, text string, label int")
    wanted = {r.n: Counter(r.w or ()) for r in table.select("n", words(F.col("text")).alias("w")).collect()}
    for binary in (True, False):
        fitted = features.word_classifier(table, binary=binary)
        assert set(fitted.vocabulary) == {w for c in wanted.values() for w in c}
        for r in fitted.features(table).collect():
            assert dict(zip((fitted.vocabulary[k] for k in r._features.indices), r._features.values, strict=True)) == {w: 1 if binary else k for w, k in wanted[r.n].items()}, r.text
            assert r._features.size == len(fitted.vocabulary)


def test_parts_of_a_batch_have_its_words():
    texts, lists = pa.array(["a b", None, "b c. b", "", "d"]), pa.array([None, ["x", "y"], None, None, None], pa.list_(pa.string()))
    found, parts = [], list(parts_of(texts, lists, 5))
    for part in parts:
        known, rows, codes = words_of_rows(*part)
        found += [Counter(known[int(c)].as_py() for r, c in zip(rows, codes, strict=True) if r == k) for k in range(len(part[0]))]
    assert len(parts) > 2 and found == [Counter("ab"), Counter("xy"), Counter("bcb"), Counter(), Counter("d")]
    assert sum(len(words_of_rows(*part)[1]) for part in parts_of(texts[:0], lists[:0])) == 0


def test_texts_are_read_twice_to_fit_their_words(spark):
    """For the vocabulary and for the vectors, however often these are needed."""
    read = spark.sparkContext.accumulator(0)
    rows = spark.sparkContext.parallelize([(f"word{k % 5} and {'bad' if k % 3 else 'good'}", k % 2) for k in range(60)], 2).map(lambda r: read.add(1) or r)
    features.word_classifier(spark.createDataFrame(rows, "text string, label int"))
    assert read.value == 120


def test_what_is_kept_is_let_go(spark):
    stored.release(spark)
    table = stored.stored(texts(spark, ["a"]), "probe")
    kept = stored.kept(texts(spark, ["b"]))
    assert table.count() == kept.count() == 1 and kept.is_cached
    path = table.inputFiles()[0]
    stored.release(spark)
    assert not kept.is_cached
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path.rpartition("/")[0]).count()
