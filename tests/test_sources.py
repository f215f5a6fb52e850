import base64
import io
import zipfile

import pytest
from paperloom.config import email, settings
from paperloom.operators.search import search_text
from paperloom.operators.tables import author_table, info_table, paper_validate
from paperloom.plans import rest
from paperloom.plans.modules import module_run
from paperloom.schemas import Corpus, texts
from paperloom.sources import bibtex, chat_model, databases, documents, github, grobid, osf, people, preregistrations, scholarly
from paperloom.sources.http import Recorded, Response, site_down
from paperloom.sources.reader import read

TEI = """<?xml version="1.0"?>
<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A  Title</title></titleStmt><sourceDesc><biblStruct><analytic>
<author><persName><forename>Ann</forename><forename>B</forename><surname>Lee</surname></persName><email>a@b.org</email><idno type="ORCID">0000</idno><affiliation><orgName type="department">D</orgName><orgName type="institution">I</orgName></affiliation></author>
</analytic><idno type="DOI">10.1234/x</idno><note type="submission">Received 3/14/22; Revision accepted April 2, 2023</note></biblStruct></sourceDesc></fileDesc>
<profileDesc><textClass><keywords><term>one</term><term>two</term></keywords></textClass><abstract><p>We did it. It worked.</p></abstract></profileDesc></teiHeader>
<text><body>
<div><p>First without head <ref type="bibr" target="#b0">(Roe, 2001)</ref>. It is at <ref type="url" target="https://osf.io/abcde">https://osf.io/abcde</ref>. By J. Doe.</p></div>
<div><head>Methods</head><p><s>We asked.</s><s>They said</s></p></div><div><p>Table 1 shows.</p></div><div><head>Results</head><p>p = .03. See <ref type="bibr" target="#b9">(Poe)</ref>!</p></div>
<figure xml:id="fig_0"><head>Fig</head><figDesc>A plot.</figDesc></figure><note place="foot" xml:id="foot_1">A note.</note></body>
<back><div type="acknowledgement"><div><head>Thanks</head><p>To all.</p></div></div><div type="references"><listBibl>
<biblStruct xml:id="b0"><analytic><title level="a">On X</title><author><persName><forename>R</forename><surname>Roe</surname></persName></author><idno type="DOI">10.1/y</idno></analytic><monogr><title level="j">J</title><imprint><date type="published">2001</date><biblScope unit="volume">3</biblScope><biblScope unit="page" from="1" to="9"/></imprint></monogr></biblStruct>
<biblStruct xml:id="b1"><monogr><title level="m">A Book</title><imprint/></monogr></biblStruct></listBibl></div></back></text></TEI>"""
JATS = """<!DOCTYPE article PUBLIC "-//NLM//DTD JATS" "x.dtd">
<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><article-meta><article-id pub-id-type="doi">10.1234/j</article-id><title-group><article-title>J Title</article-title></title-group>
<contrib-group><contrib contrib-type="author"><string-name>Jan van der Berg</string-name><xref ref-type="aff" rid="a1"/></contrib></contrib-group><aff id="a1"><institution>Uni</institution></aff>
<abstract><p>Short.</p></abstract><kwd-group><kwd>k</kwd></kwd-group></article-meta></front>
<body><sec><title>Introduction</title><p>As said <xref ref-type="bibr" rid="r1 r2">1,2</xref> before. More.</p></sec><sec><title>-</title><p>Text at <ext-link xlink:href="http://x.org">x</ext-link>.</p></sec></body>
<back><ref-list><ref id="r1"><mixed-citation publication-type="journal"><string-name><given-names>A</given-names><surname>B</surname></string-name><article-title>T</article-title><source>S</source><year>1999</year><volume>2</volume><pub-id pub-id-type="doi">10.1/z</pub-id></mixed-citation></ref></ref-list></back></article>"""
PLAIN = "Abstract\nThis is short. It is plain text here.\n\nIntroduction\nThe second paragraph is long enough.\nAnd a third one, also long enough."


def docx():
    out = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    head = '<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Results</w:t></w:r></w:p>'
    with zipfile.ZipFile(out, "w") as file:
        file.writestr("word/document.xml", f"<w:document {w}><w:body>{head}<w:p><w:r><w:t>We found </w:t></w:r><w:r><w:t>it. Good.</w:t></w:r></w:p></w:body></w:document>")
        file.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("papers")
    (path / "one").mkdir()
    (path / "one" / "paper.xml").write_text(TEI)
    (path / "two").mkdir()
    (path / "two" / "paper.xml").write_text(JATS)
    (path / "two" / "plain.txt").write_text(PLAIN)
    (path / "word.docx").write_bytes(docx())
    (path / "bad.xml").write_text("<TEI><unclosed>")
    (path / "other.csv").write_text("a,b")
    return path


@pytest.fixture(scope="module")
def papers(spark, folder):
    with pytest.warns(UserWarning, match="1 files did not read"):
        return read(spark, str(folder))


def sentences(papers, id_):
    return [(r.section, r.header, r["div"], r.p, r.s, r.text) for r in papers.full_text.where(f"id = '{id_}'").orderBy("seq").collect()]


def test_ids(papers):
    assert {r.id for r in papers.ids().collect()} == {"one/paper", "two/paper", "two/plain", "word"}


def test_tei(papers):
    assert sentences(papers, "one/paper") == [
        ("abstract", "Abstract", 0, 1, 1, "We did it."), ("abstract", "Abstract", 0, 1, 2, "It worked."),
        ("intro", "[div-01]", 1, 1, 1, "First without head (Roe, 2001)."), ("intro", "[div-01]", 1, 1, 2, "It is at <https://osf.io/abcde>."), ("intro", "[div-01]", 1, 1, 3, "By J Doe."),
        ("method", "Methods", 2, 0, 1, "Methods"), ("method", "Methods", 2, 1, 1, "We asked."), ("method", "Methods", 2, 1, 2, "They said"),
        ("table", "[div-03]", 3, 1, 1, "Table 1 shows."), ("results", "Results", 4, 0, 1, "Results"), ("results", "Results", 4, 1, 1, "p = .03."), ("results", "Results", 4, 1, 2, "See (Poe)!"),
        ("acknowledgement", "Thanks", 5, 0, 1, "Thanks"), ("acknowledgement", "Thanks", 5, 1, 1, "To all."), ("fig", "Fig", 0, 1, 3, "A plot."), ("foot", "", 1, None, 1, "A note."),
    ]
    row = info_table(papers, ["title", "doi", "keywords", "received", "accepted", "nothing"]).where("id = 'one/paper'").first()
    assert tuple(row) == ("one/paper", "A Title", "10.1234/x", "one; two", "2022-03-14", "2023-04-02", None)
    author = author_table(papers).where("id = 'one/paper'").first()
    assert (author.surname, author.given, author.email, author.orcid, author.affiliation, author.n) == ("Lee", "Ann B", "a@b.org", "0000", "D, I", 1)
    bib = {r.xref_id: r for r in papers.bib.where("id = 'one/paper'").collect()}
    assert (bib["b0"].bibtype, bib["b0"].doi, bib["b0"].journal, bib["b0"].year, bib["b0"].authors) == ("article", "10.1/y", "J", "2001", "R Roe") and "“On X.”" in bib["b0"].ref and "3, 1-9" in bib["b0"].ref
    assert (bib["b1"].bibtype, bib["b1"].title) == ("book", "A Book")
    xrefs = {r.xref_id: r for r in papers.xrefs.where("id = 'one/paper'").collect()}
    assert (xrefs["b0"].text, xrefs["b0"].section, xrefs["b0"].s) == ("First without head (Roe, 2001).", "intro", 1) and xrefs["b9"].section == "results"


def test_jats(papers):
    rows = sentences(papers, "two/paper")
    assert rows[:4] == [("abstract", "Abstract", 0, 1, 1, "Short."), ("intro", "Introduction", 1, 0, 1, "Introduction"), ("intro", "Introduction", 1, 1, 1, "As said 1,2 before."), ("intro", "Introduction", 1, 1, 2, "More.")]
    assert rows[4][-1] == "Text at <http://x.org>."
    author = author_table(papers).where("id = 'two/paper'").first()
    assert (author.surname, author.given, author.affiliation) == ("van der Berg", "Jan", "Uni")
    assert {(r.xref_id, r.text) for r in papers.xrefs.where("id = 'two/paper' AND type = 'bibr'").collect()} == {("r1", "As said 1,2 before."), ("r2", "As said 1,2 before.")}
    bib = papers.bib.where("id = 'two/paper'").first()
    assert (bib.bibtype, bib.doi, bib.authors, bib.journal, bib.volume, bib.year) == ("Article", "10.1/z", "A B", "S", "2", "1999")


def test_plain_and_word(papers):
    rows = sentences(papers, "two/plain")
    assert [r[0] for r in rows] == ["abstract"] * 3 + ["intro"] * 3 and [r[3] for r in rows] == [0, 1, 1, 0, 1, 2]
    assert sentences(papers, "word") == [("results", "Results", 1, 0, 1, "Results"), ("results", "Results", 1, 1, 1, "We found it."), ("results", "Results", 1, 1, 2, "Good.")]


def test_validate_and_modules(papers):
    rows = {r.id: r for r in paper_validate(papers).collect()}
    assert rows["one/paper"].valid and rows["one/paper"].bib == 2 and rows["word"].title == "missing" and not rows["two/plain"].valid
    out = module_run(papers, "ref_consistency")
    assert {(r.id, r.xref_id) for r in out.table.where("missing = 'bib' AND id = 'one/paper'").collect()} == {("one/paper", "b9")}


def test_write_and_load(spark, papers, tmp_path):
    papers.write(str(tmp_path / "c"))
    again = Corpus.load(spark, str(tmp_path / "c"))
    assert again.full_text.exceptAll(papers.full_text).count() == 0 and again.union(papers).full_text.count() == papers.full_text.count()


def test_apa_and_dates():
    apa = b"""<!DOCTYPE article PUBLIC "-//APA//DTD x"><article><front><article-title>T</article-title><history><string-date content-type="received"><month number="3"/><day>4</day><year>2020</year></string-date></history>
<contrib-group content-type="primary-authors"><contrib contrib-type="author" rid="a1"><surname>S</surname><given-names>G</given-names></contrib><aff id="a1">Uni</aff></contrib-group></front>
<body><fig><label>2</label><caption><title>Fig T</title><p>Cap.</p></caption></fig></body><back><fn-group><fn id="f1"><label>1</label><p>Note.</p></fn></fn-group><author-notes><p>Thanks.</p></author-notes></back></article>"""
    out = documents.parse_document("a.xml", apa)
    assert out["info"]["received"] == "2020-03-04" and out["authors"][0]["affiliation"] == [{"": "Uni"}]
    assert [(p["section"], p["text"], p["div"], p["p"]) for p in out["paragraphs"]] == [("foot", "Note.", 1, 1), ("annex", "Thanks.", 0, None), ("fig", "Fig T", 2, 0), ("fig", "Cap.", 2, 1)]
    for text, want in (("3/14/22", "2022-03-14"), ("14/3/2022", "2022-03-14"), ("2 April 2019", "2019-04-02"), ("Apr 2, 2019", "2019-04-02"), ("2020-01-05", "2020-01-05"), ("1/2/98", "1998-01-02")):
        assert documents.to_date(text).isoformat() == want
    assert documents.to_date("99/99/99") is None


def test_rest(spark):
    paper = rest.upload(spark, "a.xml", TEI.encode())
    assert rest.info(paper, "title,doi")[0]["doi"] == "10.1234/x" and rest.authors(paper)[0]["surname"] == "Lee" and len(rest.references(paper)) == 2 and len(rest.cross_references(paper)) == 2
    assert rest.search(paper, "worked")[0]["section"] == "abstract" and rest.module(paper, "exact_p")["traffic_light"] == "green"
    assert set(rest.check(paper, "exact_p,marginal")) == {"exact_p", "marginal"} and "statcheck" in rest.health()["modules"]
    for call, status in ((lambda: rest.upload(spark, "a.pdf", b"x"), 415), (lambda: rest.upload(spark, "a.xml", b""), 400), (lambda: rest.upload(spark, "a.xml", b"x" * (4 << 20)), 413), (lambda: rest.upload(spark, "a.xml", b"<a>"), 500), (lambda: rest.search(paper, "("), 400), (lambda: rest.search(paper, ""), 400), (lambda: rest.module(paper, "nope"), 400)):
        with pytest.raises(rest.RequestError) as e:
            call()
        assert e.value.status == status


# ---------------------------------------------------------------- connectors

API = "https://api.osf.io/v2"


def node(id_, type_="nodes", parent=None, **att):
    return {"id": id_, "type": type_, "attributes": att, "relationships": {"parent": {"data": {"id": parent}}} if parent else {}, "links": {}}


def osf_service():
    file = {**node("5e344fb4f6631d013e5a48cd", "files", name="data.csv", kind="file", size=10, extra={"downloads": 3}), "links": {"download": "https://files/1"}}
    folder = node("6e344fb4f6631d013e5a48cd", "files", name="sub", kind="folder")
    store = {"relationships": {"files": {"links": {"related": {"href": f"{API}/list/1"}}}}}
    below = {"relationships": {"files": {"links": {"related": {"href": f"{API}/list/2"}}}}}
    other = {**node("7e344fb4f6631d013e5a48cd", "files", name="big.R", kind="file", size=50 << 20, extra={}), "links": {"download": "https://files/2"}}
    return Recorded(
        {
            API: {}, f"{API}/nodes/abcde": {"data": node("abcde", title="Project", public=True, category="project")}, f"{API}/nodes/child": {"data": node("child", title="Part", parent="abcde", public=False)},
            f"{API}/nodes/priva": Response(401), f"{API}/users/userx": {"data": node("userx", "users", full_name="U", social={"orcid": "0"})},
            f"{API}/nodes/abcde/children/": {"data": [node("child", title="Part", parent="abcde")], "links": {"next": f"{API}/nodes/abcde/children/?page=2"}}, f"{API}/nodes/abcde/children/?page=2": {"data": [], "links": {}},
            f"{API}/nodes/abcde/files/": {"data": [store]}, f"{API}/list/1": {"data": [file, folder]}, f"{API}/files/6e344fb4f6631d013e5a48cd/": {"data": [below]}, f"{API}/list/2": {"data": [other]},
            "https://files/1": b"a,b", f"{API}/preprints/?page=1&filter[provider]=psyarxiv": {"data": [node("prepr", "preprints", title="P")], "links": {}},
        }
    )


def test_osf(spark, tmp_path):
    settings.verbose = False
    client = osf_service()
    assert osf.osf_check_id(spark, ["osf.io/abcde", "x"]) == ["abcde", None]
    table = spark.createDataFrame([("osf.io/abcde", 1), ("https://osf.io/abcde/", 2), ("osf.io/priva", 3), ("osf.io/nopex", 4), ("osf.io/userx", 5), ("bad", 6)], "text string, id int")
    rows = {r.id: r for r in osf.osf_retrieve(table, "text", client=client, find_project=True).collect()}
    assert len(rows) == 6 and rows[1].name == rows[2].name == "Project" and rows[3].osf_type == "private" and rows[4].osf_type == "unfound" and rows[5].orcid == "0" and rows[6].osf_id is None
    assert rows[1].project == "abcde" and osf.osf_parent_project("child", client) == "abcde"
    assert sum(u.endswith("nodes/abcde") for _, u in client.calls) == 2
    found = osf.contents(["abcde"], client, recursive=True)
    assert [r["osf_id"][:5] for r in found] == ["abcde", "child", "5e344", "6e344", "7e344"] and found[2]["filetype"] == "data" and found[2]["downloads"] == 3
    assert osf.osf_retrieve(spark.createDataFrame([("abcde",)], "osf_url string"), recursive=True, client=client).count() == 5
    down = osf.osf_file_download("abcde", str(tmp_path), client=client)
    assert [(d["name"], d["downloaded"]) for d in down] == [("data.csv", True), ("big.R", False)] and (tmp_path / "abcde" / "Project" / "data.csv").read_bytes() == b"a,b"
    assert osf.osf_preprint_list("psyarxiv", client=client)[0]["osf_id"] == "prepr"
    assert [f["osf_id"] for f in osf.choose_files([{"osf_id": k, "size": s << 20} for k, s in (("a", 5), ("b", 9), ("c", 11), ("d", 4))], 10, 10)] == ["d", "a"]
    with pytest.raises(ConnectionError):
        osf.osf_retrieve(table, "text", client=Recorded({API: Response(500)}))
    with pytest.raises(ValueError):
        osf.osf_delay("x")
    papers = Corpus.of(spark, full_text=texts(spark, ["At osf.io/abcde and osf.io/priva."]).drop("id").selectExpr("*", "'a' AS id"))
    out = module_run(papers, "osf_check", client=client)
    assert out.traffic_light == "red" and out.summary.first().asDict() == {"id": "a", "osf.closed": 1, "osf.open": 1}
    assert module_run(Corpus.of(spark, full_text=texts(spark, ["none"]).selectExpr("* EXCEPT (id)", "'a' AS id")), "osf_check", client=client).traffic_light == "na"


def test_aspredicted(spark):
    rows = ["</aspredicted.org/stuff>", "hi", "<https://aspredicted.org/stuff>", "hi", "<https://aspredicted.org/ stuff>", "hi", "<https://aspredicted.org/blind.php?", " x=stuff> hi", "<https://aspredicted> .org/stuff.pdf", "hi"]
    table = spark.createDataFrame([(k, t, "1", 1, k) for k, t in enumerate(rows, 1)], "s int, text string, id string, p int, seq int")
    links = [r.text for r in preregistrations.aspredicted_links(table).orderBy("seq").collect()]
    base = "https://aspredicted.org/"
    assert links == [base + x for x in ("stuff", "stuff", "stuff", "blind.php?x=stuff", "stuff.pdf")]
    body = "".join(f"<p>{h}</p><div>Answer {k}</div>" for k, h in enumerate(preregistrations.AP_SECTIONS.values()))
    client = Recorded({base + "stuff": f"<html><body><h3><b><i>Title</i></b></h3>{body}</body></html>", base + "captcha": f"<body>{preregistrations.CAPTCHA}</body>"})
    got = preregistrations.aspredicted_info(base + "stuff", client)
    assert got["AP_title"] == "Title" and got["AP_sample_size"] == "Answer 8" and got["AP_authors"] == "Answer 0"
    assert preregistrations.aspredicted_info(base + "captcha", client)["error"] == "captcha" and preregistrations.aspredicted_info(base + "no", client)["error"] == "unfound"
    out = module_run(Corpus.of(spark, full_text=table), "aspredicted", client=client)
    assert out.summary.first().AP_links == 3 and out.traffic_light == "info" and "> Answer 8" in out.report


def test_researchbox(spark):
    table = spark.createDataFrame([("At <https://researchbox.org/1> and <https://researchbox.org/1>.", "a", 1)], "text string, id string, s int")
    assert [r.text for r in preregistrations.rbox_links(table).collect()] == ["https://researchbox.org/1"]
    page = "<body><p class='file_name'>a.csv</p><p class='preview_link'>Data</p><div>SUPPLEMENTARY FILES FOR</div>Paper<div>LICENSE FOR USE</div>CC<div>BOX PUBLIC SINCE</div>2020<div>BOX CREATORS</div>Me<div>ABSTRACT</div>Text $('.file_number')</body>"
    client = Recorded({"https://researchbox.org/1": "<script>window.location.replace('https://researchbox.org/22')</script>", "https://researchbox.org/22": page})
    got = preregistrations.rbox_retrieve(preregistrations.rbox_links(table), "text", client).first()
    assert (got.RB_license, got.RB_abstract, got.files[0].name, got.files[0].description) == ("CC", "Text", "a.csv", "Data")


def test_site_down():
    client = Recorded({"https://up.org": ""})
    assert not site_down("http://up.org/page", client=client) and site_down("down.org", error=False, client=client)
    with pytest.raises(ConnectionError, match="down.org"):
        site_down("https://down.org/x", client=client)


def test_overview(papers):
    rows = {r.id: tuple(r)[1:] for r in papers.overview().collect()}
    assert rows["one/paper"] == (5, 16, 2, 2) and rows["word"] == (1, 3, 0, 0)


def test_github():
    api = f"{github.API}/o/r"
    listing = [{"name": "sub", "path": "sub", "type": "dir", "size": 0}, {"name": "a.R", "path": "a.R", "type": "file", "size": 5}]
    client = Recorded({"https://github.com/o/r": "", f"{api}/readme": {"content": base64.b64encode(b"Hi").decode()}, f"{api}/contents/": listing, f"{api}/contents/sub": [{"name": "x.csv", "path": "sub/x.csv", "type": "file", "size": 1}], f"{api}/languages": {"R": 9}})
    assert github.github_repo("https://github.com/o/r.git", client) == "o/r" and github.github_repo("https://github.com/o/none", client) == "unavailable"
    out = github.github_info("o/r", recursive=True, client=client)
    assert out["readme"] == "Hi" and [(f["path"], f["type"]) for f in out["files"]] == [("a.R", "code"), ("sub", "dir"), ("sub/x.csv", "data")] and out["languages"] == [{"language": "R", "bytes": 9}]


def test_scholarly(spark, tmp_path):
    with pytest.raises(ValueError, match="valid email"):
        email("no")
    email("me@x.org")
    work = lambda t, s, d, r=1: {"doi": f"https://doi.org/{d}", "display_name": t, "relevance_score": r, "primary_location": {"source": {"display_name": s}}, "authorships": [{"raw_author_name": "A"}]}
    url = lambda t: f"https://api.openalex.org/works?filter=title.search:{t}&mailto=me@x.org&select={scholarly.FIELDS}"
    client = Recorded(
        {
            "https://api.labs.crossref.org/works/10.1234/x?mailto=me@x.org": {"status": "ok", "message": {"title": "T"}},
            "https://api.openalex.org/works/https://doi.org/10.1234/x?mailto=me@x.org": {"abstract_inverted_index": {"b": [1, 3], "a": [0], "c": [2]}},
            url("One"): {"results": [work("One", "J", "10.1/one"), work("One", "K", "10.1/two", 9)]}, url("Main"): {"results": [work("Main", "J", "10.1/main")]},
        }
    )
    assert scholarly.crossref(["10.1234/x", "bad"], client) == {"10.1234/x": {"title": "T"}, "bad": {}}
    assert scholarly.openalex("10.1234/x", client)["10.1234/x"]["abstract"] == "a b c b" and scholarly.openalex("10.9/q", client) == {"10.9/q": {"error": "10.9/q"}}
    assert scholarly.bibsearch("One", "J", client=client)["doi"].endswith("one") and scholarly.bibsearch("One", "Z", client=client) is None and scholarly.bibsearch("One", "Z", False, client)["source"] == "K"
    assert scholarly.bibsearch("Main: sub", "J", False, client)["display_name"] == "Main" and scholarly.bibsearch("None", client=client) is None
    bib = spark.createDataFrame([("b0", "One", "J", None), ("b1", "One", "J", "10.1/have"), ("b2", "Other", "J", ""), ("b3", None, None, None)], "xref_id string, title string, journal string, doi string")
    assert [r.doi for r in scholarly.bib_add_dois(bib, client=client).orderBy("xref_id").collect()] == ["10.1/one", "10.1/have", None, None]
    (tmp_path / "a.bib").write_text('@article{k1,\n title = {{O}ne},\n journal = "J", year = 2001\n}\n@book{k2, title={B}}\n')
    assert [e.get("DOI") for e in bibtex.bibtex_add_dois(str(tmp_path / "a.bib"), client=client)] == ["10.1/one", None]
    again = bibtex.read_bibtex(spark, str(tmp_path / "a_doi.bib")).orderBy("BIBTEXKEY").collect()
    assert (again[0].TITLE, again[0].DOI, again[0].YEAR, again[1].DOI) == ("One", "10.1/one", "2001", None)
    orcid = Recorded({f"{scholarly.ORCID}/search/?q=family-name:Lee+AND+given-names:A*": "<s><path>0000-1</path></s>", f"{scholarly.ORCID}/0000-1/person": "<p><given-names>A</given-names><family-name>Lee</family-name><keyword><content>k</content></keyword></p>"})
    assert scholarly.get_orcid("Lee", "A.", orcid) == ["0000-1"] and scholarly.orcid_person(["0000-1", "x"], orcid)[0]["keywords"] == ["k"] and "error" in scholarly.orcid_person("x", orcid)[0]
    with pytest.raises(ValueError):
        scholarly.get_orcid(" ")


def test_databases(spark, tmp_path):
    assert databases.retractions(spark).count() == 0 and databases.retraction_date(spark) is None
    (tmp_path / "rw.csv").write_text("OriginalPaperDOI,RetractionNature\n10.1/a,Retraction\n10.1/a,Correction\n10.1/a,Retraction\nunavailable,Retraction\n")
    spark.conf.set(databases.FOLDER, str(tmp_path / "db"))
    databases.update_retractions(spark, str(tmp_path / "rw.csv"))
    assert [tuple(r) for r in databases.retractions(spark).collect()] == [("10.1/a", "Correction;Retraction")] and databases.retraction_date(spark) is not None
    spark.conf.unset(databases.FOLDER)


def test_chat(spark):
    url = f"{settings.chat_url}/chat/completions"
    calls = []

    def answer(data):
        calls.append(data)
        if b"fail" in data:
            return Response(400, b'{"error": {"type": "t", "code": "c", "message": "m"}}')
        if len(calls) == 1:
            return Response(429, b"{}", {"retry-after": "0"})
        return {"choices": [{"message": {"content": " yes "}}], "usage": {"total_time": 0.5, "total_tokens": 7}}

    table = spark.createDataFrame([(1, "a"), (2, "a"), (3, "fail")], "k int, text string")
    rows = {r.k: r for r in chat_model.ask(table, "Is it?", client=Recorded({url: answer})).collect()}
    assert rows[1].answer == rows[2].answer == "yes" and {rows[1].tokens, rows[2].tokens} == {7, 0} and rows[3].error and "t/c" in rows[3].error_msg and len(calls) == 3
    models = Recorded({f"{settings.chat_url}/models": {"data": [{"id": "m", "active": True}, {"id": "whisper-1", "active": True}]}})
    assert [m["id"] for m in chat_model.model_list(models)] == ["m"]
    with pytest.raises(ValueError, match="temperature"):
        chat_model.ask(table, "q", temperature=3, client=models)
    chat_model.max_calls(1)
    with pytest.raises(ValueError, match="maximum"):
        chat_model.ask(table, "q", client=models)
    assert chat_model.max_calls(0) == 1 and chat_model.max_calls(30) == 30 and chat_model.model() and chat_model.use() is False


def test_grobid(tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    client = Recorded({"http://g/api/isalive": "true", "http://g/api/processFulltextDocument": lambda data: Response(200, b"<TEI/>") if b"a.pdf" in data else Response(500)})
    assert grobid.pdf2grobid(str(tmp_path), str(tmp_path), "http://g", client=client) == [str(tmp_path / "a.xml"), None] and (tmp_path / "a.xml").read_bytes() == b"<TEI/>"
    for args, error in ((("a.pdf", ".", "ftp://g"), ValueError), (("a.pdf", ".", "http://down"), ConnectionError), ((str(tmp_path / "no.pdf"), ".", "http://g"), FileNotFoundError)):
        with pytest.raises(error):
            grobid.pdf2grobid(*args, client=client)


def test_people(spark):
    s = people.add_author(spark, people.study("S"), "Lee", "Ann", "0000-0002-7523-5539", ["con", "Software", 2])
    assert s["authors"][0]["roles"] == ["Conceptualization", "Software", "Data curation"] and s["authors"][0]["orcid"] == "0000-0002-7523-5539"
    assert people.author(spark, "L", orcid="1")["orcid"] is False and len(people.credit_roles()) == len(people.credit_roles("abbr")) == 14
    assert people.get_index({"hypotheses": [{"id": "a"}, {"id": "b"}]}, id_="b") == 1 and people.get_index({"hypotheses": []}) == 0
    with pytest.raises(ValueError, match="CRediT"):
        people.author(spark, "L", roles=["x"])


def test_empty_xml(spark, tmp_path):
    (tmp_path / "notext.xml").write_text("<TEI><teiHeader/><text/></TEI>")
    assert read(spark, str(tmp_path / "notext.xml")).full_text.count() == 0
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no xml"):
        read(spark, str(tmp_path / "none"))
    assert search_text(read(spark, str(tmp_path / "notext.xml")), "x").count() == 0


def test_files_are_packed_by_bytes_and_bad_ones_are_rows(spark, folder, tmp_path):
    from paperloom.sources import files, reader

    sizes = [5, 1, 1, 9 << 20, 1, 1, 12 << 20, 20 << 20, 1]
    parts = files.packed([("", str(k), n) for k, n in enumerate(sizes)], 16 << 20)
    assert [[int(x[1]) for x in p] for p in parts] == [[0, 1, 2, 3, 4, 5], [6], [7], [8]]
    assert {name.rpartition("/")[2] for _, name, _ in files.listed([str(folder)])} == {"paper.xml", "plain.txt", "word.docx", "bad.xml"}
    assert files.listed([str(folder), f"file://{folder}/bad.xml"]) [0][1].endswith("bad.xml")
    one = reader.files_source(spark, [str(folder)], 1)
    assert one.rdd.getNumPartitions() == 5 and {r.path.rpartition("/")[2]: r.error is None for r in one.collect()}["bad.xml"] is False
    errors = reader.read_errors(spark, str(folder)).collect()
    assert [r.path.rpartition("/")[2] for r in errors] == ["bad.xml"] and "ParseError" in errors[0].error
    gone = files.PaperReader({"paths": "[]"}).read(files.Files([(str(tmp_path), f"{tmp_path}/none.xml", 3)]))
    assert next(gone).to_pylist()[0]["error"].startswith("FileNotFoundError")


def test_folders_that_only_spark_opens(spark, folder):
    from paperloom.sources import reader

    by_pattern = reader.files_source(spark, [f"{folder}/*"])
    assert {r.path.rpartition("/")[2] for r in by_pattern.collect()} == {"paper.xml", "plain.txt", "word.docx", "bad.xml"}


def test_one_parse_in_a_plan(spark):
    from paperloom import paper_queries, queries

    d = "/root/testdata/sf0.001"
    for name in ("nlm_citations", "tei_citations", "nlm_text", "apa_notes"):
        plan = queries.QUERIES[name](spark, d)._jdf.queryExecution().toString()
        assert "MapInArrow" not in plan and "MapInPandas" not in plan
        assert "kind" in plan.partition("PartitionFilters")[2]
    stored = reader_table(spark)
    assert {r.kind for r in stored.select("kind").distinct().collect()} == {"file", "text", "bib", "xref"}
    assert paper_queries.corpus_of


def reader_table(spark):
    from paperloom.sources import reader

    return reader.by_kind(reader.parse_files(spark.createDataFrame([("a/b.xml", TEI.encode()), ("a/c.xml", b"<bad")], "path string, content binary")))


def test_written_files(spark, tmp_path):
    from paperloom.sources.text_files import write_files

    rows = [("a/b/c.txt", "é"), ("a/d.txt", None), ("e.txt", "")]
    out = {r.name: r.bytes for r in write_files(spark.createDataFrame(rows, "name string, content string"), str(tmp_path / "new")).collect()}
    assert out == {"a/b/c.txt": 2, "a/d.txt": 0, "e.txt": 0} and (tmp_path / "new/a/b/c.txt").read_text() == "é"
    assert sorted(str(p.relative_to(tmp_path / "new")) for p in (tmp_path / "new").rglob("*") if p.is_file()) == sorted(out)


def test_paragraphs_are_dealt_once(spark, tmp_path):
    """Numbering, cutting and classifying share one shuffle by paper and two orders."""
    (tmp_path / "a.txt").write_text("Methods\nIt began a long while ago. It ended.\nResults\nNothing was found by anyone.")
    (tmp_path / "b.xml").write_text("<TEI><text><body><div><head>Intro</head><p>One. Two.</p></div></body></text></TEI>")
    text = read(spark, str(tmp_path)).full_text
    structured = text._jdf.queryExecution().executedPlan().toString()
    assert structured.count("Exchange hashpartitioning(id") == 2 and structured.count("Sort [") <= 3
    got = [tuple(r) for r in text.where("p > 0").orderBy("id", "seq").select("header", "section", "div", "p", "s", "text").collect()]
    assert got == [("Methods", "method", 1, 1, 1, "It began a long while ago."), ("Methods", "method", 1, 1, 2, "It ended."), ("Results", "results", 2, 1, 1, "Nothing was found by anyone."), ("Intro", "intro", 1, 1, 1, "One."), ("Intro", "intro", 1, 1, 2, "Two.")]


def test_folders_are_listed_in_tasks(spark, folder, tmp_path, monkeypatch):
    """Names of files don't pass through the driver, and tasks don't grow with their number."""
    import pyarrow as pa
    from paperloom.sources import files, reader

    want = {(name, size) for _, name, size in files.listed([str(folder)])}
    monkeypatch.setattr(files, "listed", None)
    for paths in ([str(folder)], [f"file://{folder}/"], [str(folder), f"{folder}/one", f"file://{folder}/bad.xml", f"{folder}/two/"]):
        assert sorted((r.path, r.bytes) for r in files.found_files(spark, paths).collect()) == sorted(want)
    assert files.found_files(spark, []).count() == 0 and files.found_files(spark, [f"{folder}/other.csv"]).count() == 0
    few = reader.files_source(spark, [str(folder)], 1)
    assert few.rdd.getNumPartitions() == 5 and {r.path for r in few.collect()} == {name for name, _ in want}
    monkeypatch.setattr(files, "TASKS", 3)
    few = reader.files_source(spark, [str(folder)], 1)
    assert few.rdd.getNumPartitions() == 3 and {r.path for r in few.collect()} == {name for name, _ in want}
    monkeypatch.setattr(files, "BATCH", 2 * files.OPEN)
    gone = pa.RecordBatch.from_pylist([{"root": str(tmp_path), "path": f"{tmp_path}/{k}.xml", "bytes": 3} for k in range(5)])
    assert [b.num_rows for b in files.parse_found(iter([gone, gone]))] == [2] * 5


def test_local_folders_are_read_on_as_they_are_listed(tmp_path):
    import os

    from paperloom.sources import files
    from pyarrow.fs import LocalFileSystem, SubTreeFileSystem

    for name in ("a.txt", "b/c.XML", "b/d/e.docx", "f.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    os.symlink(tmp_path / "b", tmp_path / "g")
    os.symlink(tmp_path / "none", tmp_path / "h.txt")
    got = sorted(files.within(LocalFileSystem(), str(tmp_path)), key=str)
    assert got == [(f"{tmp_path}/a.txt", 5), (f"{tmp_path}/b", None), (f"{tmp_path}/g", None)]
    assert sorted(files.within(SubTreeFileSystem(str(tmp_path), LocalFileSystem()), ""), key=str) == [("a.txt", 5), ("b", None), ("g", None)]
    assert list(files.within(LocalFileSystem(), f"{tmp_path}/b/c.XML")) == [(f"{tmp_path}/b/c.XML", 7)]


def test_papers_of_a_folder_are_not_broadcast(spark):
    from paperloom import queries

    plan = queries.QUERIES["folder_papers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Join") == 1
