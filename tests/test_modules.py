import re

import pytest
from paperloom import queries
from paperloom.config import settings
from paperloom.operators.validation import accuracy, validate
from paperloom.plans import report as reports
from paperloom.plans.modules import module_find, module_help, module_info, module_list, module_run, module_template
from paperloom.schemas import Corpus, texts
from paperloom.sources.http import Recorded
from pyspark.sql import functions as F

ACCEPTED = [
    "p=0.05", "p = 0.05", "p < 0.05", "p > 0.05", "p ~ 0.05", "p ≈ 0.05", "p ≠ 0.05", "p ≤ 0.05", "p ≥ 0.05", "p ≪ 0.05", "p ≫ 0.05", "p << 0.05", "p >> 0.05", "p == 0.05", "p-value = 0.05",
    "pvalue = 0.05", "p = .05", "p=.05", "p\t=\t.05", "p  =  0.05", "p = n.s.", "p = ns", "p = 5.0e-2", "p = 5.0 e-2", "p = 5.0 e -2", "p = 5.0x10^-2", "p = 5.0 x 10^-2", "p = 5.0*10^-2", "p = 5.0 x 10 ^ -2",
]
REJECTED = ["up = 0.05", "p = stuff", "p = -0.05", "p less than 0.05", "p = 12.05"]


def corpus(spark, values, id_="a"):
    table = texts(spark, values).withColumns({"id": F.lit(id_), "s": F.col("seq").cast("int")})
    return Corpus.of(spark, full_text=table)


def test_p_values(spark):
    out = module_run(corpus(spark, ACCEPTED), "all_p_values")
    rows = out.table.orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(len(ACCEPTED)))
    assert [r.p_value for r in rows] == [0.05] * 20 + [None, None] + [0.05] * 7
    assert out.traffic_light == "info" and out.summary.first().p_values == 29
    assert module_run(corpus(spark, REJECTED), "all_p_values").traffic_light == "na"


def test_exact_p(spark):
    values = ["p < .05", "p < .01", "p < .001", "p < .0005", "p > .05", "p = n.s.", "p = .03", "p ≤ .05", "p ~ .05", "p << .05", "p <= .01"]
    out = module_run(corpus(spark, values), "exact_p")
    assert out.traffic_light == "red" and out.summary.first().imprecise_p == out.table.count() == 8
    assert module_run(corpus(spark, ["p = .03"]), "exact_p").traffic_light == "green"
    assert module_run(corpus(spark, ["none"]), "exact_p").traffic_light == "na"


def test_marginal(spark):
    out = module_run(corpus(spark, ["This effect was marginally significant.", "This effect approached significance.", "Significant."]), "marginal")
    assert out.table.count() == 2 and out.traffic_light == "red"
    assert module_run(corpus(spark, ["no"]), "marginal").traffic_light == "green"


def test_effect_sizes(spark):
    values = ["t(20) = 2.1, p = .04, Cohen's d = 0.5", "t(20) = 2.1, p = .04", "F(1, 20) = 4.4, ηp2 = .2", "F(1, 20) = 4.4, p = .04", "t = 3 and r = .4; t = 4", "T(20) = 2, f(1, 2) = 3"]
    out = module_run(corpus(spark, values), "effect_size")
    row = out.summary.first()
    assert (row.ttests_with_es, row.ttests_without_es, row.Ftests_with_es, row.Ftests_without_es) == (2, 1, 1, 1) and out.traffic_light == "yellow"
    assert {r.test_text for r in out.table.where("test = 't-test'").collect()} == {"t(20) = 2.1", "t = 3; t = 4"}
    for light, some in (("na", values[-1:]), ("green", values[:1]), ("red", values[1:2])):
        assert module_run(corpus(spark, some), "effect_size").traffic_light == light


def test_effect_sizes_of_equal_sentences(spark):
    twice = corpus(spark, ["t(20) = 2.1, p = .04"] * 2)
    twice = Corpus.of(spark, full_text=twice.full_text.withColumns({"seq": F.lit(1), "s": F.lit(1)}))
    out = module_run(twice, "effect_size")
    assert out.table.count() == out.summary.first().ttests_without_es == 2


def test_osf_projects_are_told_apart(spark, tmp_path):
    """Customers whose numbers have more than five digits have a project each."""
    rows = spark.range(123450, 123462).select(F.col("id").alias("c_custkey"))
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    got = {int(r.id): (r.open, r.closed, r.unfound) for r in queries.QUERIES["osf_check_summary"](spark, str(tmp_path)).collect()}
    assert got == {k: (int(k % 4 == 0), int(k % 4 in (1, 3)), int(k % 4 == 2)) for k in range(123450, 123462)}


def test_a_result_is_judged_once(spark, monkeypatch):
    from paperloom.operators import statcheck

    judged, judge = [], statcheck.judge
    monkeypatch.setattr(statcheck, "judge", lambda rows, *more: judged.append(rows.count()) or judge(rows, *more))
    rows = statcheck.stats(texts(spark, ["t(20) = 4.23, p = .002 and t(20) = 4.23, p = .002", "F(2, 30) = 3.50, p = .043"]).withColumn("id", F.lit("a")).crossJoin(spark.range(5).select(F.col("id").cast("int").alias("k")))).collect()
    assert judged == [2] and sorted((r.raw, r.error) for r in rows) == [("F(2, 30) = 3.50, p = .043", False)] * 5 + [("t(20) = 4.23, p = .002", True)] * 10


def test_statcheck(spark):
    from paperloom.operators.statcheck import stats

    table = texts(spark, ["t(20) = 4.23, p = .002", "t(20) = 4.23, p = 0.0004", "(z = 1.4, p < .05)", "z = 1.4, p < .05", "H = 2.2, p = .000"])
    t = stats(table, stat="t").orderBy("seq").collect()
    assert [r.error for r in t] == [True, False] and stats(table, stat="Z").count() >= 1 and stats(table, all_p_values=True).count() == 5
    more = texts(spark, ["F(2, 30) = 3.50, p = .043.", "χ2(1, N = 100) = 3.84, p = .05", "r(48) = .30, p = .034", "t(28) = -2.20, p = .036", "t(28) = 2.20, p < .001"])
    rows = stats(more).orderBy("seq").collect()
    assert [(r.test_type, r.error) for r in rows] == [("F", False), ("chisq", False), ("cor", False), ("t", False), ("t", True)]
    out = module_run(corpus(spark, ["t(97.7) = 2.9, p = 0.005", "t(97.2) = -1.96, p = 0.152"]), "statcheck")
    assert [r.raw for r in out.table.collect()] == ["t(97.2) = -1.96, p = 0.152"] and out.traffic_light == "red" and out.summary.first().stats_found == 2


def references(spark):
    bib = spark.createDataFrame([("b0", "r0", "10.1/x", "a"), ("b1", "r1", "10.1/y", "a"), ("b0", "r", None, "c")], "xref_id string, ref string, doi string, id string")
    xrefs = spark.createDataFrame([("b0", "bibr", "(1)", "one (1)", "a"), ("b0", "bibr", "(1)", "two (1)", "a"), (None, "bibr", "(2)", "lost (2)", "a")], "xref_id string, type string, contents string, text string, id string")
    none = lambda kind: F.lit(None).cast(kind)
    xrefs = xrefs.withColumns({"section": none("string"), "div": none("int"), "p": none("int"), "s": none("int")})
    return Corpus.of(spark, info=spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), bib=bib, xrefs=xrefs)


def test_references(spark):
    papers = references(spark)
    out = module_run(papers, "ref_consistency")
    assert {(r.id, r.xref_id, r.missing) for r in out.table.collect()} == {("a", "b1", "xrefs"), ("a", None, "bib"), ("c", "b0", "xrefs")} and out.traffic_light == "red"
    assert {tuple(r) for r in out.summary.collect()} == {("a", 2, 3, 1, 1), ("b", 0, 0, 0, 0), ("c", 1, 0, 0, 1)}
    db = spark.createDataFrame([("10.1/x", "Retraction")], "doi string, retractionwatch string")
    rw = module_run(papers, "retractionwatch", db=db)
    assert rw.table.count() == 2 and rw.traffic_light == "yellow" and {tuple(r) for r in rw.summary.collect()} == {("a", 2), ("b", 0), ("c", 0)}
    assert module_run(papers, "retractionwatch", db=db.limit(0)).traffic_light == "green"
    warned = spark.createDataFrame([("10.1/y", "Paper Y", "often wrong")], "doi string, reftext string, warning string")
    mis = module_run(papers, "miscitation", db=warned)
    assert mis.table.count() == 1 and mis.table.first().text is None and "often wrong" in mis.report


def test_power(spark):
    method = corpus(spark, ["A power analysis gave N = 40.", "No numbers, power."]).full_text.withColumns({"section": F.lit("method")})
    papers = Corpus.of(spark, full_text=method)
    assert module_run(papers, "power").traffic_light == "yellow"
    answer = '[{"type": "apriori", "test": "t", "sample": 40, "alpha": 0.05, "power": 0.8, "es": 0.4, "es_metric": "d", "software": null}]'
    client = Recorded({f"{settings.chat_url}/chat/completions": {"choices": [{"message": {"content": answer}}], "usage": {"total_time": 0.1, "total_tokens": 9}}})
    out = module_run(papers, "power", client=client)
    row = out.table.first()
    assert (row.type, row["sample"], row.software, row.complete) == ("apriori", "40", None, False) and out.traffic_light == "red"


def test_chain_and_endings(spark):
    papers = corpus(spark, ["p = .03", "p < .05"])
    out = module_run(module_run(papers, "exact_p"), "exact_p")
    assert out.summary.columns == ["id", "exact_p", "imprecise_p", "exact_p.exact_p", "imprecise_p.exact_p"]


def test_own_modules(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    papers = corpus(spark, ["significant", "no"])
    path = module_template("mine")
    assert module_find("mine").title == "Title of the module" and module_info(path)["function"] == "mine"
    out = module_run(papers, "mine")
    assert out.summary.first().mine == 1 and out.traffic_light == "info" and "mine" in {m["name"] for m in module_list("modules")}
    (tmp_path / "bad.py").write_text("def f(:")
    (tmp_path / "fails.py").write_text("def fails(corpus):\n    raise KeyError('x')\n")
    (tmp_path / "needs.py").write_text("import no_such_package\ndef f(corpus):\n    pass\n")
    (tmp_path / "table.py").write_text("def t(corpus):\n    return corpus.full_text\n")
    assert module_run(papers, "table").traffic_light == "info"
    for name, error, text in (("bad", ValueError, "code has errors"), ("fails", RuntimeError, "produced errors"), ("needs", ImportError, "required but not installed"), ("unknown", LookupError, "no modules that matched")):
        with pytest.raises(error, match=text):
            module_run(papers, name)
    with pytest.raises(ValueError, match="letters, numbers"):
        module_template("a-b")


def test_help_and_list():
    names = {m["name"] for m in module_list()}
    assert {"all_p_values", "all_urls", "aspredicted", "effect_size", "exact_p", "marginal", "miscitation", "osf_check", "power", "ref_consistency", "retractionwatch", "statcheck"} == names
    assert "marginal" in module_help() and "Effect Sizes" in module_help("effect_size")


def test_report(spark, tmp_path):
    papers = corpus(spark, ["p = .03", "p < .05 | x", "This was marginally significant"])
    path = reports.report(papers, ("exact_p", "marginal", "retractionwatch"), str(tmp_path / "r.qmd"))
    text = open(path).read()
    assert "## Exact P-Values {.red}" in text and "## RetractionWatch {.green}" in text and "Showing 1 of 1 rows" in text
    out = module_run(papers, "exact_p")
    assert reports.module_report(out, header=0).startswith("Exact P-Values\n\n") and "header" not in reports.module_report(out)
    cut = reports.module_report(module_run(papers, "marginal"), header="", max_rows=1, trunc_cell=10)
    assert "This wa..." in cut and not re.match("#", cut)
    with pytest.raises(ValueError, match="one paper"):
        reports.report(papers.union(corpus(spark, ["x"], "b")))


def test_validate(spark):
    papers = corpus(spark, ["p = .03", "p < .05"]).union(corpus(spark, ["none"], "b"))
    summary = spark.createDataFrame([("a", 1, 1), ("b", 0, 1)], "id string, exact_p long, imprecise_p long")
    out = validate(papers, "exact_p", summary=summary)
    assert out.stats == {"n_papers": 2, "summary": {"exact_p": 1.0, "imprecise_p": 0.5}} and "imprecise_p: 0.50" in str(out)
    table = spark.createDataFrame([("a", "p < .05"), ("a", "p < .1")], "id string, text string")
    assert validate(papers, "exact_p", table=table).stats["table"] == {"true_positive": 1, "false_positive": 0, "false_negative": 1}
    assert validate(papers, "exact_p", traffic_light="red").matches["traffic_light"] is True
    for expected, text in (({"x": 1}, "did not return any objects"), ({"table": table.drop("id")}, "must have an `id`"), ({"table": table.withColumnRenamed("text", "y")}, "same columns")):
        with pytest.raises(ValueError, match=text):
            validate(papers, "exact_p", **expected)


def test_accuracy(spark):
    rows = [(k % 2 == 0, (k % 2 == 0) != (k < 20)) for k in range(100)]
    out = accuracy(spark.createDataFrame(rows, "expected boolean, observed boolean"))
    assert (out["hits"], out["misses"], out["false_alarms"], out["correct_rejections"]) == (40, 10, 10, 40)
    assert round(out["d_prime"], 2) == 1.68 and round(out["beta"], 6) == 1 and out["sensitivity"] == 0.8 and round(out["specificity"], 6) == 0.2 and out["accuracy"] == 0.8
    perfect = accuracy(spark.createDataFrame([(True, True), (False, False)], "expected boolean, observed boolean"))
    assert perfect["sensitivity"] == 0.5 and perfect["d_prime"] == 0
