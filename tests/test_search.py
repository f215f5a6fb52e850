import pytest
from paperloom.operators.search import expand_text, search_text
from paperloom.schemas import Corpus, text_table, texts


@pytest.fixture(scope="module")
def paper(spark):
    rows = [("abstract", "Abstract", 1, 1, 1, "The abstract."), ("method", "Method", 2, 2, 1, "Method starts.")]
    rows += [("method", "Participants", 3, 3, 1, "Participants"), *(("method", "Participants", 3, 4, k, f"Part {k}") for k in (1, 2, 3))]
    rows += [("method", "Design", 4, 5, 1, "Design is part of it."), *(("method", "Design", 4, 6, k, f"More , text {k}") for k in (1, 2, 3, 4))]
    table = spark.createDataFrame([(*r, "id.xml", k) for k, r in enumerate(rows)], "section string, header string, div int, p int, s int, text string, id string, seq long")
    return text_table(table)


def ordered(df):
    return df.orderBy("seq").collect()


def test_sentences(paper):
    assert [r.text for r in ordered(search_text(paper, "^part [0-9]"))] == ["Part 1", "Part 2", "Part 3"]
    assert [r.text for r in ordered(search_text(paper, "more"))] == [f"More, text {k}" for k in (1, 2, 3, 4)]


def test_paragraphs(paper):
    out = ordered(search_text(paper, "part|method|more", section="method", return_="paragraph"))
    assert [r.p for r in out] == [2, 3, 4, 5, 6] and out[2].text == "Part 1 Part 2 Part 3" and all(r.s is None for r in out)


def test_divs_sections_and_documents(paper):
    out = ordered(search_text(paper, "part|method", section="method", return_="div"))
    assert [r["div"] for r in out] == [2, 3, 4] and out[1].text == "Participants\n\nPart 1 Part 2 Part 3"
    (one,) = ordered(search_text(paper, "Part 2", return_="section"))
    assert one.section == "method" and (one.header, one["div"], one.p, one.s) == (None,) * 4 and one.text.count("\n\n") == 4
    (whole,) = ordered(search_text(paper, "Part 2", return_="id"))
    assert whole.text.startswith("The abstract.\n\nMethod starts.") and whole.section is None


def test_matches_are_not_merged(spark):
    out = search_text(texts(spark, ["p = .05 and p = .05", "p=.1"]), r"p\s*=\s*\.\d+", return_="match")
    assert sorted(r.text for r in out.collect()) == ["p = .05", "p = .05", "p=.1"]


def test_fixed_patterns_and_case(spark):
    table = texts(spark, ["a.b", "axb", "A.B", None])
    assert [r.text for r in search_text(table, "a.b", fixed=True).collect()] == ["a.b"]
    assert search_text(table, "a.b").count() == 3 and search_text(table, "a.b", ignore_case=False).count() == 2
    assert [r.text for r in search_text(texts(spark, ["1+1=2 1+1"]), "1+1", fixed=True, return_="match").collect()] == ["1+1", "1+1"]
    assert search_text(texts(spark, ["ÉCOLE"]), "école").count() == 1


def test_bad_arguments(spark, paper):
    with pytest.raises(ValueError, match="Check the pattern argument"):
        search_text(paper, "(a")
    with pytest.raises(ValueError, match="return_"):
        search_text(paper, "a", return_="word")
    with pytest.raises(TypeError):
        search_text("text")
    with pytest.raises(ValueError, match="text"):
        search_text(spark.createDataFrame([(1,)], "x int"))


def test_results_can_be_searched_again(paper):
    assert search_text(search_text(paper, "part"), "[0-9]").count() == 3
    assert search_text(paper, "no such").columns == paper.columns


def test_one_paper_or_many(spark, paper):
    other = paper.replace("id.xml", "b.xml", "id")
    both = Corpus.of(spark, full_text=paper.union(other))
    assert search_text(both, "part", return_="paragraph").where("id = 'b.xml'").drop("id").exceptAll(search_text(paper, "part", return_="paragraph").drop("id")).count() == 0
    assert search_text(both.subset(["b.xml"]), "part").count() == search_text(paper, "part").count()


def test_expand(paper):
    hits = search_text(paper, "Part 2", return_="match")
    value = lambda **k: expand_text(hits, paper, **k).first().expanded
    assert value() == "Part 2" and value(plus=1) == "Part 2 Part 3" and value(minus=5, plus=1) == "Part 1 Part 2 Part 3"
    assert value(expand_to="paragraph") == "Part 1 Part 2 Part 3"
    assert value(expand_to="div") == "Participants\n\nPart 1 Part 2 Part 3"
    assert value(expand_to="section").startswith("Method starts.\n\nParticipants\n\n")
    assert value(expand_to="div", plus=3) == value(expand_to="div")


def test_expand_keeps_rows_and_falls_back(spark, paper):
    hits = search_text(paper, "[a-z]", return_="match").limit(40)
    assert expand_text(hits, paper).count() == hits.count()
    lost = spark.createDataFrame([("abc", None, "id.xml")], "text string, div int, id string")
    assert expand_text(lost, paper).first().expanded == "abc"
    gap = spark.createDataFrame([(1, 1, 1, "a", "x"), (1, 1, 3, "c", "x")], "div int, p int, s int, text string, id string")
    assert expand_text(search_text(gap, "a"), gap, plus=1).first().expanded == "a"
