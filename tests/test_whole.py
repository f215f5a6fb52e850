"""Queries that do the whole of a job, where those of the same name without a suffix take a part of the rows or words."""

import pytest
from paperloom import queries
from paperloom.functions import json_columns
from paperloom.plans import builtin
from paperloom.plans.modules import module_run
from paperloom.schemas import Corpus
from paperloom.sources import scholarly
from paperloom.sources.http import Recorded
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"


def test_inverted_index_has_all_words(spark, tmp_path):
    texts = {1: "a b a  c " * 40, 2: "", 3: None, 4: " x", 5: "one"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.abstract for r in queries.QUERIES["inverted_index_whole"](spark, str(tmp_path)).collect()} == texts
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    assert {r.doc_id: r.abstract for r in queries.QUERIES["inverted_index_whole"](spark, D).collect()} == docs


def test_flagged_references_have_every_citation(spark):
    rows = queries.QUERIES["retraction_flags_whole"](spark, D).collect()
    places = {}
    for r in rows:
        places.setdefault((r.id, r.xref_id), []).append(r.s)
    cited = spark.read.parquet(f"{D}/lineitem.parquet").groupBy("l_orderkey").count()
    want = {str(r.l_orderkey): r["count"] for r in cited.collect()}
    assert {k[1]: len([s for s in v if s is not None]) for k, v in places.items()} == {k[1]: want.get(k[1], 0) for k in places}
    assert max(map(len, places.values())) > 1
    summary = queries.QUERIES["retraction_summary_whole"](spark, D).collect()
    assert sum(r[f"rw_{s}"] for r in summary for s in queries.SEGMENTS) == len(rows)


def test_too_many_kinds_are_an_error(spark):
    n = json_columns.MOST
    table = spark.range(n + 1).select(F.lit("a").alias("id"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("kind"))
    with pytest.raises(ValueError, match="distinct values of kind"):
        builtin.pivot_counts(table, "kind", "n_")
    answers = table.select(F.to_json(F.create_map("kind", F.lit("1"))).alias("answer"))
    with pytest.raises(ValueError, match="distinct values of k "):
        json_columns.json_expand(answers)


def test_miscitation_reports_every_doi(spark):
    n = 120
    refs = [("p", f"b{k}", f"10.1/{k}", "r") for k in range(n)]
    corpus = Corpus.of(spark, info=spark.createDataFrame([("p",)], "id string"), bib=spark.createDataFrame(refs, "id string, xref_id string, doi string, ref string"))
    db = spark.createDataFrame([(d, "a paper", "often miscited") for _, _, d, _ in refs], "doi string, reftext string, warning string")
    report = module_run(corpus, "miscitation", db=db).report
    assert all(f"**{d}**" in report for _, _, d, _ in refs)


def test_too_many_titles_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(scholarly, "MOST_TITLES", 2)
    bib = spark.createDataFrame([(None, f"t{k}", "j") for k in range(3)], "doi string, title string, journal string")
    with pytest.raises(ValueError, match="more than 2 distinct titles"):
        scholarly.bib_add_dois(bib, client=Recorded({}))
