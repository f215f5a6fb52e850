import math
from itertools import product
from statistics import NormalDist

import numpy as np
import pytest
from paperloom.functions import ids, tails
from paperloom.functions.json_columns import json_expand
from paperloom.functions.porter import STEP2, STEP3, STEP4, stem, stem_texts, stems, with_stems
from paperloom.functions.text import guard_initials, sentences, words
from paperloom.operators.features import distinctive_words, feature_classifier, text_features
from pyspark.sql import functions as F

ENDS = [e + f for e in [*dict(STEP2), *dict(STEP3), *STEP4, "at", "bl", "iz", "tt", "ll", "y", "ee"] for f in ("", "s", "ed", "ing", "e")]
TEXTS = [
    "This effect had a large effect size of x = 0.4, the effect", "An effect of medium size", "The effect is medium", "Medium effect", "Some effects are medium", "Effect: medium y", "One effect medium z",
    "A large effect", "Larger effect of 0.5", "The effect was large", "Small effect", "The small effect of an x", "No effect at 1.2", "Effect size 3",
]


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.out for r in rows.select("k", f(F.col("v")).alias("out")).orderBy("k").collect()]


def test_sentences(spark):
    values = ["One. Two! Three? four", "See e.g. this. p = .05 is small. Next", "By J. A. Smith. Done.", "Smith et al. (2020) found it. Yes (no). No", "", None, "A 3.5 b. 12 c"]
    assert column(spark, values, lambda x: sentences(guard_initials(x))) == [
        ["One.", "Two!", "Three?", "four"], ["See e.g. this. p = .05 is small.", "Next"], ["By J A Smith.", "Done."], ["Smith et al. (2020) found it.", "Yes (no).", "No"], [], None, ["A 3.5 b. 12 c"],
    ]


def test_words(spark):
    assert column(spark, ["It's 0.4, École-x 1,000!", None], words) == [["it's", "0.4", "école", "x", "1,000"], None]


def test_porter():
    # Examples of the published description.
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit vietnamization vietnam operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formality formal sensitivity sensit triplicate triplic formative form formalize formal electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ effective effect probate probat rate rate cease ceas controll control roll roll large larg".split()
    for word, want in zip(pairs[::2], pairs[1::2], strict=True):
        assert stem(word) == want, word


def test_orcid_and_doi(spark):
    values = ["0000-0002-7523-5539", "https://orcid.org/000000020247239X", "0000-0002-0247-2394", "1", None]
    assert column(spark, values, ids.check_orcid) == ["0000-0002-7523-5539", "0000-0002-0247-239X", None, None, None]
    assert column(spark, ["10.1177/0956797614520714", "10.1/x", "10.1234/a.", "", None], ids.doi_form) == [True, False, False, False, False]


def test_osf_ids(spark):
    values = ["pngda", "https://osf.io/pngda", "osf .io/ pngda", "5e344fb4f6631d013e5a48cd", "pnda", None, "osf.io/pngda/?view_only=abc", "https://osf.io/pngda_v2", "see osf.io/pngda."]
    assert column(spark, values, ids.osf_id) == ["pngda", "pngda", "pngda", "5e344fb4f6631d013e5a48cd", None, None, "pngda", "pngda_v2", "pngda"]


def test_files(spark):
    names = ["a.R", "b.SAV", "c.sps", "d", "e.xyz", "Code_Book.txt", "my data dict.pdf", "README", "x.jasp"]
    rows = ids.with_filetype(spark.createDataFrame([(n,) for n in names], "name string")).select("name", "filetype", ids.file_category(F.col("name"), F.col("filetype")).alias("c"))
    got = {r.name: (r.filetype, r.c) for r in rows.collect()}
    assert got["a.R"] == ("code", "code") and got["b.SAV"] == ("data", "data") and got["c.sps"] == ("stats", "code") and got["e.xyz"] == (None, None)
    assert got["Code_Book.txt"][1] == got["my data dict.pdf"][1] == "codebook" and got["README"][1] == "readme" and got["x.jasp"][0] == "data;stats"


def test_json(spark):
    answers = ['{"number": 1, "letter": "A", "bool": true}', '{"number": 2, "letter": "B", "bool": false}', '{"number": 3, "letter": ""}', "not json", '{"number": 5, "letter": ["E", "F"], "bool": false}', None, '[{"number": 7}, {"number": 8}]']
    table = spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "id int, answer string")
    rows = json_expand(table.where("id < 6")).orderBy("id").collect()
    assert [r.number for r in rows] == [1, 2, 3, None, 5, None] and [r.letter for r in rows] == ["A", "B", "", None, "E; F", None]
    assert [r.bool for r in rows] == [True, False, None, None, False, None] and [r.error for r in rows] == [None, None, None, "parsing error", None, None]
    assert json_expand(table, fields=["number"]).where("id = 6").first().number == "7; 8"
    assert json_expand(table.select("answer").limit(0)).columns == ["answer", "error"]


def test_stems_on_columns_equal_the_rules_word_by_word(spark):
    """All words of the tables, and all short ones of letters that the rules look at."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.explode(words(F.col("text"))).alias("word")).distinct()
    made = ["".join(x) for n in range(1, 6) for x in product("aeylst", repeat=n)] + [a + b for a in ("", "b", "tr", "a", "hop", "fil", "ay", "yy", "rate", "syzyg", "+", "conn3") for b in ENDS]
    table = rows.union(spark.createDataFrame([(x,) for x in made], "word string")).distinct()
    found = with_stems(table).collect()
    assert len(found) > 9000 and [(r.word, r.stem) for r in found if stem(r.word) != r.stem] == []
    texts = spark.createDataFrame([(1, ["cats", "a", "cats", "hopping"]), (2, []), (3, None)], "k int, w array<string>")
    assert {r.k: r.stems for r in stem_texts(texts, "k", F.col("w")).collect()} == {1: ["cat", "a", "cat", "hop"], 2: [], 3: None}


def test_tails(spark):
    """Against published tables, and forms in which the functions are closed."""

    def rows(f, *columns):
        table = spark.createDataFrame([tuple(float(x) for x in r) for r in zip(*columns, strict=True)], ", ".join(f"c{k} double" for k in range(len(columns))))
        return [r[0] for r in table.select(f(*(F.col(f"c{k}") for k in range(len(columns))))).collect()]

    assert np.allclose(rows(tails.t_two_sided, [2.086, 0, -12.706], [20, 5, 1]), [0.05, 1, 0.05], atol=1e-4)
    assert np.allclose(rows(tails.f_upper, [4.35, 3.32, 0, -1], [1, 2, 3, 2], [20, 30, 10, 9]), [0.05, 0.05, 1, 1], atol=1e-3)
    assert np.allclose(rows(tails.chi2_upper, [3.8415, 18.307, 124.342, 0], [1, 10, 100, 3]), [0.05, 0.05, 0.05, 1], atol=1e-4)
    assert np.allclose(rows(tails.normal_two_sided, [1.96, -2.576, 0]), [0.05, 0.01, 1], atol=1e-4)
    assert math.isclose(rows(tails.r_two_sided, [0.3], [48])[0], 0.0343, abs_tol=2e-4)
    x = [0.01, 0.5, 1, 3, 7, 20, 60]
    assert np.allclose(rows(tails.normal_two_sided, x), [math.erfc(v / math.sqrt(2)) for v in x], rtol=1e-11, atol=0)
    assert np.allclose(rows(tails.t_two_sided, x, [1] * 7), [1 - 2 / math.pi * math.atan(v) for v in x], rtol=1e-10, atol=1e-14)
    for df in (1, 9, 200, 5000, 10**6):
        assert np.allclose(rows(tails.f_upper, x, [2] * 7, [df] * 7), [(1 + 2 * v / df) ** (-df / 2) for v in x], rtol=1e-8, atol=0)
    assert np.allclose(rows(tails.chi2_upper, x, [2] * 7), [math.exp(-v / 2) for v in x], rtol=1e-11, atol=0)
    many = [900, 990, 1000, 1010, 1100, 1500]  # a sum of Poisson probabilities
    assert np.allclose(rows(tails.chi2_upper, many, [1000] * 6), [math.fsum(math.exp(-v / 2 + k * math.log(v / 2) - math.lgamma(k + 1)) for k in range(500)) for v in many], rtol=1e-9, atol=0)
    assert np.allclose(rows(tails.log_gamma, [0.5, 1, 2, 3.25, 100, 1e6]), [math.lgamma(v) for v in (0.5, 1, 2, 3.25, 100, 1e6)], rtol=1e-12, atol=1e-12)
    assert rows(tails.t_two_sided, [1, 1], [0, -3]) == [None, None] and rows(tails.chi2_upper, [1], [0]) == [None]


def test_normal_quantile(spark):
    p = [1e-9, 0.001, 0.2, 0.5, 0.8, 0.975, 1 - 1e-9]
    found = [r[0] for r in spark.createDataFrame([(x,) for x in p], "p double").select(tails.normal_quantile(F.col("p"))).collect()]
    assert np.allclose(found, [NormalDist().inv_cdf(x) for x in p], rtol=1e-7, atol=1e-12)
    assert spark.range(1).select(tails.normal_quantile(F.lit(1.0))).first()[0] is None


def test_distinctive_words(spark):
    table = spark.createDataFrame([(t, int(k < 7)) for k, t in enumerate(TEXTS)], "text string, classification int")
    rows = distinctive_words(table).collect()
    assert rows[0].word == "medium" and list(rows[0].asDict()) == ["word", "n_0", "n_1", "total", "freq_0", "freq_1", "difference"]
    by = {r.word: r for r in rows}
    assert by["effect"].n_1 == 9 and by["larg"].n_0 == 2 and "###" in by and by["medium"].freq_1 == 6 / 7
    assert {"0.4", "0.5"} & {r.word for r in distinctive_words(table, numbers="specific", min_total=1).collect()}
    assert "###" not in {r.word for r in distinctive_words(table, numbers="remove", min_total=1).collect()}
    assert distinctive_words(table, n=5).count() == 5 and "medium" not in {r.word for r in distinctive_words(table, stop_words=["medium"]).collect()}
    assert {r.word for r in distinctive_words(table, stem=False).collect()} >= {"large", "medium"}
    for bad in (table.withColumn("classification", F.lit(1)), table.withColumn("classification", F.length("text"))):
        with pytest.raises(ValueError, match="two classes"):
            distinctive_words(bad)


def test_text_features(spark):
    table = spark.createDataFrame([(k, t) for k, t in enumerate([*TEXTS, "", None])], "k int, text string")
    rows = text_features(table, ["effect", "medium", "###"]).orderBy("k").collect()
    assert list(rows[0].asDict()) == ["k", "text", "word_count", "has_number", "has_equals", "effect", "medium"]
    assert [r.effect for r in rows] == [1] * 14 + [0, 0] and rows[0].word_count == 12 and rows[0].has_equals == rows[0].has_number == 1 and rows[1].has_number == 0
    assert (rows[14].word_count, rows[15].word_count) == (0, 0)
    counts = text_features(table, ["effect"], word_count=False, has_number=False, has_symbol=["%"], values="count").orderBy("k").first()
    assert counts.effect == 3 and list(counts.asDict()) == ["k", "text", "has_%", "effect"]


def test_feature_classifier(spark):
    table = spark.createDataFrame([(t, int(k < 7)) for k, t in enumerate(TEXTS)], "text string, y int")
    rows = text_features(table, ["medium", "effect"])
    model = feature_classifier(rows, "y", ["medium", "effect"])
    assert model.transform(rows).where("prediction = y").count() >= 12


def test_sentences_keep_their_digits(spark):
    table = spark.createDataFrame([("0 In all. 1 Of 1. Then it was 2",)], "text string")
    assert table.select(sentences(F.col("text"))).first()[0] == ["0 In all.", "1 Of 1.", "Then it was 2"]


def test_texts_are_stemmed_in_their_rows(spark):
    """Texts with repeated words, no words and null, in slices of an Arrow batch; no row leaves its partition."""
    import pyarrow as pa

    lists = [["relational", "cats", "cats"], None, [], ["hopping", "a"], None, ["ponies", "cats"]]
    want = [None if x is None else [stem(w) for w in x] for x in lists]
    texts = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, w array<string>").coalesce(1)
    found = stem_texts(texts, "k", F.col("w"))
    assert {r.k: r.stems for r in found.collect()} == dict(enumerate(want))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    for a in range(len(lists)):
        assert stems.func(pa.array(lists, pa.list_(pa.string())).slice(a)).to_pylist() == want[a:]
