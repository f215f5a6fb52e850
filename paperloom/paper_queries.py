"""Queries of papers in files, of whole corpora, and of what services answered, with SQL.

Files are made from the tables and read back; services' answers are tables, too.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import settings
from .operators import sections, tables, validation
from .operators.bibliography import add_dois
from .operators.search import search_text
from .plans.modules import module_run
from .queries import FLAGGED, LINES, PAPERS, REFERENCES, REPORTED, TALKS, _flagged, _papers, _references, _tei_papers, doc_lines, escaped, query, read, reported, squeezed, talks
from .schemas import Corpus, concat_tables, text_table
from .sources.bibtex import bibtex_fields
from .sources.chat_model import ask
from .sources.http import Answers
from .sources.preregistrations import AP_SECTIONS, rbox_retrieve
from .sources.reader import corpus_of, parse_files
from .sources.reader import read as read_papers
from .sources.text_files import write_files
from .streaming.files import shared_dir

# ---------------------------------------------------------------- JATS

def _filled(template: str, **values) -> Column:
    """A template with {name} for columns."""
    out: list[Column] = []
    for part in template.split("{"):
        name, closed, rest = part.partition("}")
        out += [values[name], F.lit(rest)] if closed else [F.lit(part)]
    return F.concat(*out)


JATS = """<article><front><article-meta><article-id pub-id-type="doi">10.3/{key}</article-id><title-group><article-title>On {source}</article-title></title-group>
<contrib-group content-type="primary-authors"><contrib contrib-type="author" rid="a1"><name><surname>{lang}</surname><given-names>Ada</given-names></name><xref ref-type="aff" rid="a1"/></contrib><contrib contrib-type="author"><string-name>Jan Piet van der {lang}</string-name></contrib></contrib-group>
<aff id="a1"><institution>House {source}</institution></aff><pub-date pub-type="print"><day>{day}</day><month>{month}</month><year>2001</year></pub-date>
<abstract><p>About {lang}</p></abstract><kwd-group><kwd>{lang}</kwd><kwd>{source}</kwd></kwd-group></article-meta></front>
<body>{body}<sec><title>Outlook</title><p>Nothing is here. Seen in {source} before <xref ref-type="bibr" rid="r1 r2">(1, 2)</xref> by many. It ends.</p></sec></body>
<back><fn-group><fn id="fn1"><label>1</label><p>Note on {lang}</p></fn></fn-group><author-notes><p>Thanks to {lang}.</p></author-notes><fig id="f1"><label>2</label><caption><title>Plot of {source}</title><p>It shows {lang}.</p></caption></fig><ref-list><ref id="r1"><mixed-citation publication-type="journal"><person-group person-group-type="author"><name><surname>{lang}</surname><given-names>Bo</given-names></name></person-group>
<article-title>Of {source}</article-title><source>Journal</source><year>{year}</year><volume>3</volume><fpage>1</fpage><lpage>9</lpage><pub-id pub-id-type="doi">10.2/{key}</pub-id></mixed-citation></ref>
<ref id="r2"><mixed-citation publication-type="book"><string-name><given-names>Cy</given-names><surname>{lang}</surname></string-name>, <source>Book of {source}</source>, <year>{year}</year></mixed-citation></ref>
<ref id="r3"><mixed-citation publication-type="book-chapter"><string-name><given-names>Di</given-names><surname>Roe</surname></string-name> <string-name><given-names>Ed</given-names><surname>Poe</surname></string-name>, <article-title>Chapter {key}</article-title>, <source>Book of {source}</source>, <year>{year}</year>, <fpage>{key}</fpage></mixed-citation></ref></ref-list></back></article>"""
DOCTYPES = {"nlm": '<!DOCTYPE article PUBLIC "-//NLM//DTD Journal Publishing DTD v2.3//EN" "j.dtd">', "apa": '<!DOCTYPE article PUBLIC "-//APA//DTD APA Journal Archive DTD v1.0//EN" "a.dtd">'}


def _jats_papers(spark: SparkSession, d: str, kind: str) -> Corpus:
    """Each document written as a JATS file (a section for each line, one citation, one reference), and read back."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "")
    body = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("<sec><title>Part "), (i + 1).cast("string"), F.lit("</title><p>"), escaped(x), F.lit("</p></sec>"))), "")
    text = lambda x: x.cast("string")
    key = F.col("doc_id")
    content = _filled(
        JATS, key=text(key), source=F.col("source"), lang=F.col("lang"), body=body, year=text(1900 + key % 100), day=text(1 + key % 28), month=text(1 + key % 12),
    )
    files = read(spark, d, "documents").select(F.concat(F.lit(f"{kind}/"), text(key), F.lit(".xml")).alias("path"), F.concat(F.lit(DOCTYPES[kind]), content).cast("binary").alias("content"))
    return corpus_of(parse_files(files), files)


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 'On ' || source AS title, lang || '; ' || source AS keywords, '10.3/' || doc_id AS doi, 'About ' || lang AS description FROM documents")
def nlm_info(spark: SparkSession, d: str) -> DataFrame:
    return tables.info_table(_jats_papers(spark, d, "nlm"), ["title", "keywords", "doi", "description"])


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 'On ' || source AS title, '10.3/' || doc_id AS doi, '2001-' || lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') AS pub_print FROM documents")
def apa_info(spark: SparkSession, d: str) -> DataFrame:
    return tables.info_table(_jats_papers(spark, d, "apa"), ["title", "doi", "pub_print"])


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS id, lang AS surname, 'Ada' AS given, 'House ' || source AS affiliation, 1 AS n FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'van der ' || lang, 'Jan Piet', '', 2 FROM documents"""
)
def nlm_authors(spark: SparkSession, d: str) -> DataFrame:
    """One author whose name comes in parts, and one whose name has particles."""
    return tables.author_table(_jats_papers(spark, d, "nlm")).select("id", "surname", "given", "affiliation", "n")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 'foot' AS section, 'fn1' AS header, 'Note on ' || lang AS text FROM documents")
def apa_notes(spark: SparkSession, d: str) -> DataFrame:
    return _jats_papers(spark, d, "apa").full_text.where("header = 'fn1'").select("id", "section", "header", "text")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 'fig' AS section, 2 AS div, unnest([0, 1]) AS p, 'Plot of ' || source AS header, unnest(['Plot of ' || source, 'It shows ' || lang || '.']) AS text FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), 'annex', 0, NULL, 'Author Notes', 'Thanks to ' || lang || '.' FROM documents")
def apa_figures(spark: SparkSession, d: str) -> DataFrame:
    """Captions of figures, and what authors note."""
    return _jats_papers(spark, d, "apa").full_text.where("section IN ('fig', 'annex')").select("id", "section", "div", "p", "header", "text")


@query(
    """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, source, lang, doc_id, CAST(1900 + doc_id % 100 AS VARCHAR) AS year FROM documents)
SELECT id, 'r1' AS xref_id, '10.2/' || doc_id AS doi, 'Article' AS bibtype, 'Of ' || source AS title, 'Journal' AS journal, year, 'Bo ' || lang AS authors, '3' AS volume, '1' AS fpage, '9' AS lpage FROM d
UNION ALL SELECT id, 'r2', '', 'Book', '', 'Book of ' || source, year, 'Cy ' || lang, '', '', '' FROM d
UNION ALL SELECT id, 'r3', '', 'InCollection', 'Chapter ' || doc_id, 'Book of ' || source, year, 'Di Roe; Ed Poe', '', CAST(doc_id AS VARCHAR), '' FROM d"""
)
def nlm_references(spark: SparkSession, d: str) -> DataFrame:
    """An article, a book and a chapter in each list of references."""
    return _jats_papers(spark, d, "nlm").bib.select("id", "xref_id", "doi", "bibtype", "title", "journal", "year", "authors", "volume", "fpage", "lpage")


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS id, unnest(['r1', 'r2']) AS xref_id, '(1, 2)' AS contents, 'Seen in ' || source || ' before (1, 2) by many.' AS text,
  (1 + len(list_filter(string_split(text, chr(10)), lambda x: x <> '')))::INT AS div, 1 AS p, 2 AS s FROM documents"""
)
def nlm_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations of two references at once, with the sentences that they stand in."""
    return _jats_papers(spark, d, "nlm").xrefs.where("type = 'bibr'").select("id", "xref_id", "contents", "text", "div", "p", "s")


#: Single capital letters lose their full stop. The letter's border is found by a mark before it.
GUARDED = "replace(regexp_replace(regexp_replace(chr(1) || text, '([^\\p{L}\\p{N}_])', '\\1' || chr(1), 'g'), chr(1) || '([A-Z])\\.', '\\1', 'g'), chr(1), '')"
#: White space as XML readers take it: runs are one space.
SPACES = r"[\s\x00-\x1F\x7F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
PARTS = rf"""l AS (SELECT CAST(doc_id AS VARCHAR) AS id, generate_subscripts(l, 1) AS k, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
n AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY k))::INT AS div, trim(regexp_replace(text, '{SPACES}', ' ', 'g')) AS text FROM l WHERE text <> ''),
x AS (SELECT id, div, replace(replace({GUARDED}, '{{{{', '<'), '}}}}', '>') AS text FROM n)"""


def _joined() -> Column:
    """The sentences of a group in their order, with a space between."""
    each = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "s", "text"))), lambda x: x["text"]), " ")
    return F.trim(F.regexp_replace(each, r"\s+", " ")).alias("text")


def _whole(text: DataFrame, *keys) -> DataFrame:
    """The sentences of each place in their order."""
    return text.groupBy(*keys).agg(_joined())


@query(f"WITH {PARTS} SELECT id, div, 'Part ' || div AS header, text FROM x WHERE text <> ''")
def nlm_text(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, section by section."""
    return _whole(_jats_papers(spark, d, "nlm").full_text.where("p > 0 AND header LIKE 'Part %'"), "id", F.col("div").cast("int").alias("div"), "header")


@query(f"WITH {PARTS} SELECT id, div, 'Part ' || div AS header, text FROM x WHERE text <> ''")
def tei_text(spark: SparkSession, d: str) -> DataFrame:
    text = _tei_papers(spark, d).full_text.where("p > 0 AND (section IS NULL OR section <> 'abstract')")  # headers are in paragraph 0
    return _whole(text, "id", F.col("div").cast("int").alias("div"), "header")


# ---------------------------------------------------------------- folders


@query(
    rf"""WITH l AS (SELECT doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n?|\n') AS l FROM documents)),
n AS (SELECT doc_id, k, trim(regexp_replace(line, '{SPACES}', ' ', 'g')) AS text FROM l),
x AS (SELECT doc_id, k, replace(replace({GUARDED}, '{{{{', '<'), '}}}}', '>') AS text FROM n WHERE text <> ''),
w AS (SELECT doc_id, count(*) AS paragraphs, string_agg(text, ' ' ORDER BY k) AS text FROM x GROUP BY doc_id)
SELECT lang || '/' || source || '/' || doc_id AS id, lang = 'en' AS tei, coalesce(paragraphs, 0) AS paragraphs, coalesce(w.text, '') AS text FROM documents LEFT JOIN w USING (doc_id)"""
)
def folder_papers(spark: SparkSession, d: str) -> DataFrame:
    """Each document a file, TEI or plain, in a folder of its language and in it one of its source; the folder is then read as it is."""
    docs = read(spark, d, "documents")
    name = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))
    tei = F.col("lang") == "en"
    body = F.array_join(F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), r"\r\n?|\n"), lambda x: x != ""), lambda x: F.concat(F.lit("<p>"), escaped(x), F.lit("</p>"))), "")
    content = F.when(tei, F.concat(F.lit("<TEI><text><body><div><head>Whole</head>"), body, F.lit("</div></body></text></TEI>"))).otherwise(F.coalesce("text", F.lit("")))
    folder = f"{shared_dir(spark)}/papers-{uuid.uuid4().hex}"
    write_files(docs.select(F.concat(name, F.when(tei, ".xml").otherwise(".txt")).alias("name"), content.alias("content")).repartition("name"), folder).agg(F.sum("bytes")).collect()
    papers = read_papers(spark, folder, partition_bytes=2 << 20)
    kinds = papers.info.select("id", F.col("filename").endswith(".xml").alias("tei"))
    sentences = papers.full_text.select(F.col("id").alias("_id"), "seq", "s", "text", "div", "p")
    # The heading of a TEI file is paragraph 0. Joined by sorting: Spark takes two columns of a wide table for few bytes, and may send all their rows through the driver.
    rows = kinds.hint("merge").join(sentences, (F.col("id") == F.col("_id")) & (~F.col("tei") | (F.col("p") > 0)), "left")
    paragraphs = F.count_distinct(F.when(F.col("_id").isNotNull(), F.struct("div", "p"))).alias("paragraphs")
    return rows.groupBy("id", "tei").agg(paragraphs, _joined()).select("id", "tei", "paragraphs", "text")


# ---------------------------------------------------------------- TEI: people, dates, citations

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Of {name}</title></titleStmt><sourceDesc><biblStruct><analytic>
<author><persName><forename>Ada</forename><surname>{name}</surname></persName><email>a@x.org</email><idno type="ORCID">0000-0002-7523-5539</idno><affiliation><orgName type="department">Stars</orgName><orgName type="institution">{group}</orgName></affiliation></author>
<author><persName><forename>Bo</forename><surname>{group}</surname></persName></author></analytic><note type="submission">Received {received}; accepted {accepted}.</note></biblStruct></sourceDesc></fileDesc></teiHeader>
<text><body><div><head>Methods</head><p>It began. As {name} said <ref type="bibr" target="#b{b}">(first)</ref> and again <ref type="bibr" target="#b0">(second)</ref> there. Then it went on.</p></div></body></text></TEI>"""


def _tei_cited(spark: SparkSession, d: str) -> Corpus:
    """A TEI file for each customer, read back."""
    key = F.col("c_custkey")
    day = F.make_date(1990 + key % 30, 1 + key % 12, 1 + key % 28)
    received = F.when(key % 3 == 0, F.date_format(day, "d MMMM yyyy")).when(key % 3 == 1, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "MMM d, yyyy"))
    accepted = F.date_format(F.date_add(day, 40), "yyyy-MM-dd")
    content = _filled(TEI, name=F.replace("c_name", F.lit("#"), F.lit(" ")), group=F.col("c_mktsegment"), received=received, accepted=accepted, b=(1 + key % 9).cast("string"))
    files = read(spark, d, "customer").select(F.concat(F.lit("tei/"), key.cast("string"), F.lit(".xml")).alias("path"), content.cast("binary").alias("content"))
    return corpus_of(parse_files(files), files)


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS id, 'Ada' AS given, replace(c_name, '#', ' ') AS surname, 'a@x.org' AS email, '0000-0002-7523-5539' AS orcid, 'Stars, ' || c_mktsegment AS affiliation, 1 AS n FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'Bo', c_mktsegment, NULL, NULL, '', 2 FROM customer"""
)
def tei_authors(spark: SparkSession, d: str) -> DataFrame:
    return tables.author_table(_tei_cited(spark, d)).select("id", "given", "surname", "email", "orcid", "affiliation", "n")


@query(
    """WITH d AS (SELECT c_custkey, make_date((1990 + c_custkey % 30)::BIGINT, (1 + c_custkey % 12)::BIGINT, (1 + c_custkey % 28)::BIGINT) AS day FROM customer)
SELECT CAST(c_custkey AS VARCHAR) AS id, strftime(day, '%Y-%m-%d') AS received, strftime(day + 40, '%Y-%m-%d') AS accepted FROM d"""
)
def tei_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates written in three ways."""
    return tables.info_table(_tei_cited(spark, d), ["received", "accepted"])


@query(
    """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS id, 'As ' || replace(c_name, '#', ' ') || ' said (first) and again (second) there.' AS text, c_custkey % 9 + 1 AS b FROM customer)
SELECT id, 'b' || b AS xref_id, '(first)' AS contents, text, 'method' AS section, 1 AS div, 1 AS p, 2 AS s FROM c UNION ALL SELECT id, 'b0', '(second)', text, 'method', 1, 1, 2 FROM c"""
)
def tei_citations(spark: SparkSession, d: str) -> DataFrame:
    return _tei_cited(spark, d).xrefs.select("id", "xref_id", "contents", "text", "section", "div", "p", "s")


# ---------------------------------------------------------------- Word, plain text, BibTeX


def _word_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        files = []
        for body in batch["content"]:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as file:
                file.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
            files.append(out.getvalue())
        yield pd.DataFrame({"path": batch["path"], "content": files})


@query(f"WITH {PARTS} SELECT id, div, 'Part ' || div AS header, text FROM x WHERE text <> ''")
def word_text(spark: SparkSession, d: str) -> DataFrame:
    """Each document written as a Word file (a heading and a paragraph for each line), and read back."""
    heading = lambda i: F.concat(F.lit('<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Part '), (i + 1).cast("string"), F.lit("</w:t></w:r></w:p>"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "")
    body = F.array_join(F.transform(lines, lambda x, i: F.concat(heading(i), F.lit("<w:p><w:r><w:t>"), escaped(x), F.lit("</w:t></w:r></w:p>"))), "")
    rows = read(spark, d, "documents").select(F.concat(F.lit("word/"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), body.alias("content"))
    files = rows.mapInPandas(_word_files, "path string, content binary")
    return _whole(corpus_of(parse_files(files), files).full_text.where("p > 0"), "id", F.col("div").cast("int").alias("div"), "header")


@query(
    rf"""WITH {LINES}, x AS (SELECT id, div, p, header, trim(regexp_replace(replace(replace({GUARDED}, '{{{{', '<'), '}}}}', '>'), '\s+', ' ', 'g')) AS text FROM lines WHERE NOT regexp_matches(text, '\[div-\d+\]'))
SELECT * FROM x WHERE text <> ''"""
)
def plain_text_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Plain texts as read, paragraph by paragraph."""
    return _whole(sections.read_plain_text(read(spark, d, "documents")), "id", "div", "p", "header")


#: Every line cut into sentences: a word ends one with ! or ?, or with a full stop if the next letter is no small one.
SENTENCES = f"""{LINES}, w0 AS (SELECT id, seq, header, div, p, list_filter(string_split_regex({GUARDED}, '\\s+'), lambda x: x <> '') AS l FROM lines),
w AS (SELECT id, seq, header, div, p, generate_subscripts(l, 1) AS k, unnest(l) AS word FROM w0),
f AS (SELECT *, first_value(nullif(regexp_extract(word, '\\p{{L}}'), '') IGNORE NULLS) OVER (PARTITION BY id, seq ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM w),
e AS (SELECT *, regexp_matches(word, '[!?][)\\]"''’”]{{0,2}}$') OR (regexp_matches(word, '[.][)\\]"''’”]{{0,2}}$') AND (next IS NULL OR NOT regexp_matches(next, '\\p{{Ll}}'))) AS ends FROM f),
g AS (SELECT *, (1 + coalesce(sum(ends::INT) OVER (PARTITION BY id, seq ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS s FROM e),
sentences AS (SELECT id, seq, header, div, p, s, replace(replace(string_agg(word, ' ' ORDER BY k), '{{{{', '<'), '}}}}', '>') AS text FROM g GROUP BY ALL)"""


@query(f"WITH {SENTENCES} SELECT id, div, p, s, text FROM sentences")
def sentence_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every line cut into sentences."""
    rows = sections.split_sentences(doc_lines(spark, d))
    return rows.select("id", "div", "p", "s", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


@query(
    f"""WITH {SENTENCES}, h AS (SELECT *, lower(regexp_replace(coalesce(header, ''), '\\s', '', 'g')) AS low FROM sentences),
n AS (SELECT *, contains(low, 'abstract') AS abstract, CASE WHEN contains(low, 'result') THEN 'results' WHEN contains(low, 'discuss') THEN 'discussion' WHEN contains(low, 'method') OR contains(low, 'material') THEN 'method'
  WHEN contains(low, 'intro') THEN 'intro' WHEN contains(low, 'abstract') THEN 'abstract' END AS named FROM h),
b AS (SELECT *, min(CASE WHEN named <> 'abstract' THEN seq * 100000 + s END) OVER (PARTITION BY id) AS start FROM n),
i AS (SELECT *, CASE WHEN seq * 100000 + s < start AND NOT abstract THEN 'intro' ELSE named END AS sec, sum(abstract::INT) OVER (PARTITION BY id ORDER BY seq, s ROWS UNBOUNDED PRECEDING) AS part FROM b)
SELECT id, CASE WHEN abstract THEN sec ELSE coalesce(sec, last_value(CASE WHEN NOT abstract THEN sec END IGNORE NULLS) OVER (PARTITION BY id, part ORDER BY seq, s ROWS UNBOUNDED PRECEDING)) END AS section, header, div, p, s, text
FROM i WHERE NOT regexp_matches(text, '\\[div-\\d+\\]')"""
)
def plain_text_reader(spark: SparkSession, d: str) -> DataFrame:
    """Documents as classified sentences."""
    rows = sections.read_plain_text(read(spark, d, "documents"))
    return rows.select("id", "section", "header", "div", "p", "s", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


@query("SELECT 'ARTICLE' AS category, 'k' || p_partkey AS bibtexkey, p_name AS title, p_brand AS journal, CAST(1900 + p_size AS VARCHAR) AS year FROM part")
def bibtex_entries(spark: SparkSession, d: str) -> DataFrame:
    """An entry of BibTeX for each part, values in braces, quotes and bare, read back."""
    source = F.concat(
        F.lit("@comment{none}\n@article{k"), F.col("p_partkey").cast("string"), F.lit(",\n  Title = {{"), F.substring("p_name", 1, 1), F.lit("}"), F.expr("substring(p_name, 2)"),
        F.lit('},\n  journal = "'), "p_brand", F.lit('",\n  year = '), (1900 + F.col("p_size")).cast("string"), F.lit("\n}\n"),
    )
    entries = bibtex_fields(read(spark, d, "part").select(source.alias("value")), "value")
    return entries.select(*(F.col("fields")[n].alias(n.lower()) for n in ("CATEGORY", "BIBTEXKEY", "TITLE", "JOURNAL", "YEAR")))


# ---------------------------------------------------------------- searches and corpora


@query(f"WITH {LINES} SELECT DISTINCT id, div, p, {squeezed('text')} AS text FROM lines WHERE NOT regexp_matches(text, '(?i)tion')")
def search_without(spark: SparkSession, d: str) -> DataFrame:
    """Lines that a phrase is not in, by a pattern that looks ahead."""
    return search_text(doc_lines(spark, d), "^(?!.*tion)").select("id", "div", "p", "text")


@query(
    f"""WITH {REPORTED}, {REFERENCES}, ids AS (SELECT DISTINCT id FROM bib)
SELECT id, (SELECT max(div) FROM reported r WHERE r.id = ids.id)::INT AS sections, (SELECT count(*) FROM reported r WHERE r.id = ids.id) AS sentences,
  (SELECT count(*) FROM bib b WHERE b.id = ids.id) AS references, (SELECT count(*) FROM xrefs x WHERE x.id = ids.id) AS citations FROM ids WHERE id IN (SELECT id FROM reported)"""
)
def corpus_overview(spark: SparkSession, d: str) -> DataFrame:
    """The papers that have references, of all, and what each contains."""
    cited = _references(spark, d)
    return Corpus.of(spark, full_text=reported(spark, d), bib=cited.bib, xrefs=cited.xrefs).subset(cited.bib).overview()


@query(f"WITH {TALKS} SELECT DISTINCT id, section, div, p, s, text, seq FROM talks")
def corpus_union(spark: SparkSession, d: str) -> DataFrame:
    """Two corpora that have sentences in common."""
    whole = Corpus.of(spark, full_text=talks(spark, d))
    part = Corpus.of(spark, full_text=talks(spark, d).where("section = 'user'"))
    return whole.union(part).full_text.select("id", "section", "div", "p", "s", "text", "seq")


@query(f"WITH {REFERENCES}, more AS (SELECT CAST(o_orderkey % 50 AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS xref_id, o_orderstatus AS ref, '10.1/' || o_custkey AS doi FROM orders) SELECT id, xref_id, ref, NULL AS doi FROM bib UNION ALL SELECT * FROM more")
def tables_together(spark: SparkSession, d: str) -> DataFrame:
    """The references of two corpora; what one lacks is null."""
    return concat_tables([_references(spark, d), _flagged(spark, d)[0]], "bib").select("id", "xref_id", "ref", "doi")


@query(
    f"""WITH {PAPERS}, c AS (SELECT *, CASE WHEN doi = '' THEN 'missing' WHEN starts_with(doi, '10.1234/') THEN '' ELSE 'invalid' END AS d,
  CASE WHEN title = '' THEN 'missing' WHEN starts_with(title, 'Corr') THEN 'corrigendum' WHEN starts_with(title, 'A Reply') THEN 'reply' ELSE '' END AS t FROM papers)
SELECT id, d = '' AND t <> 'missing' AND description <> '' AS valid, d AS doi, t AS title, CASE WHEN description = '' THEN 'missing' ELSE '' END AS abstract, CAST(id AS BIGINT) % 3 + 1 AS bib FROM c"""
)
def paper_check_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every paper with one reference or more."""
    papers = _papers(spark, d)
    each = F.explode(F.sequence(F.lit(1), (F.col("id").cast("bigint") % 3 + 1).cast("int"))).alias("n")
    bib = papers.info.select("id", each).select("id", F.concat(F.lit("b"), F.col("n").cast("string")).alias("xref_id"))
    return tables.paper_validate(Corpus.of(spark, info=papers.info, bib=bib))


VALUES = "e AS (SELECT doc_id AS id, quality, toxic FROM labels), o AS (SELECT doc_id AS id, (n_chars > 500)::INT AS quality, CASE WHEN lang = 'en' THEN 0 END AS toxic FROM documents)"


def _values(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    expected = read(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    observed = read(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") > 500).cast("int").alias("quality"), F.when(F.col("lang") == "en", 0).alias("toxic"))
    return validation.compare_summaries(expected, observed)


@query(
    f"""WITH {VALUES} SELECT id, e.quality AS quality_expected, e.toxic AS toxic_expected, o.quality AS quality_observed, o.toxic AS toxic_observed,
  e.quality IS NOT DISTINCT FROM o.quality AS quality, e.toxic IS NOT DISTINCT FROM o.toxic AS toxic FROM e FULL JOIN o USING (id)"""
)
def validate_summary_whole(spark: SparkSession, d: str) -> DataFrame:
    """All documents; those without a label are the ones that lack a match."""
    return _values(spark, d)[0]


@query(f"WITH {VALUES} SELECT avg((e.quality IS NOT DISTINCT FROM o.quality)::INT) AS quality, avg((e.toxic IS NOT DISTINCT FROM o.toxic)::INT) AS toxic FROM e FULL JOIN o USING (id)")
def validate_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of values of each column that are as expected."""
    return _values(spark, d)[1]


# ---------------------------------------------------------------- modules

OFTEN = ("10.1/1", "10.1/2", "10.1/4")


@query(
    f"""WITH {FLAGGED} SELECT id, {", ".join(f"min(xref_id) FILTER (WHERE doi = '{x}') AS c{k}" for k, x in enumerate(OFTEN))} FROM bib GROUP BY id"""
)
def miscitation_summary(spark: SparkSession, d: str) -> DataFrame:
    """The reference of each paper to three papers that are often miscited."""
    db = spark.createDataFrame([(x, "a paper", "read it") for x in OFTEN], "doi string, reftext string, warning string")
    summary = module_run(_flagged(spark, d)[0], "miscitation", db=db).summary
    column = lambda x: F.col(f"`miscite_{x}`") if f"miscite_{x}" in summary.columns else F.lit(None).cast("string")
    return summary.select("id", *(column(x).alias(f"c{k}") for k, x in enumerate(OFTEN)))


@query(f"WITH {REPORTED}, n AS (SELECT DISTINCT id, div, p, s, text FROM reported WHERE starts_with(text, 'A t(') OR starts_with(text, 'An F(')) SELECT ids.id, count(n.text) AS stats_found FROM (SELECT DISTINCT id FROM reported) ids LEFT JOIN n USING (id) GROUP BY ids.id")
def statcheck_counts(spark: SparkSession, d: str) -> DataFrame:
    return module_run(Corpus.of(spark, full_text=reported(spark, d)), "statcheck").summary.select("id", "stats_found")


def _powered(spark: SparkSession, d: str) -> Corpus:
    key = F.col("p_partkey")
    text = F.when(key % 3 == 0, F.concat(F.lit("A power analysis gave N = "), key.cast("string"), F.lit("."))).when(key % 3 == 1, "No Power here.").otherwise(F.concat(F.lit("It has "), key.cast("string"), F.lit(" parts.")))
    section = F.when(key % 5 == 0, "results").otherwise("method")
    rows = read(spark, d, "part").select((key % 40).cast("string").alias("id"), section.alias("section"), F.lit(1).alias("div"), F.expr("p_partkey div 80").cast("int").alias("p"), key.cast("int").alias("s"), text.alias("text"), key.alias("seq"))
    return Corpus.of(spark, full_text=text_table(rows))


POWERED = """t AS (SELECT CAST(p_partkey % 40 AS VARCHAR) AS id, CASE WHEN p_partkey % 5 = 0 THEN 'results' ELSE 'method' END AS section, 1 AS div, (p_partkey // 80)::INT AS p, p_partkey AS seq,
  CASE p_partkey % 3 WHEN 0 THEN 'A power analysis gave N = ' || p_partkey || '.' WHEN 1 THEN 'No Power here.' ELSE 'It has ' || p_partkey || ' parts.' END AS text FROM part),
h AS (SELECT DISTINCT id, section, div, p FROM t WHERE section = 'method' AND regexp_matches(text, '(?i)power') AND regexp_matches(text, '[0-9]')),
e AS (SELECT id, section, div, p, string_agg(text, ' ' ORDER BY seq) AS expanded FROM t JOIN h USING (id, section, div, p) GROUP BY ALL)"""


@query(f"WITH {POWERED} SELECT * FROM e")
def power_table(spark: SparkSession, d: str) -> DataFrame:
    """The paragraphs of methods that report power in numbers."""
    return module_run(_powered(spark, d), "power").table


@query(f"WITH {POWERED} SELECT ids.id, count(e.p) AS n FROM (SELECT DISTINCT id FROM t) ids LEFT JOIN e USING (id) GROUP BY ids.id")
def power_counts(spark: SparkSession, d: str) -> DataFrame:
    return module_run(_powered(spark, d), "power").summary.select("id", F.col("`power.n`").alias("n"))


# ---------------------------------------------------------------- services, whose answers were gathered before


def _customers(spark: SparkSession, d: str, text: str) -> Corpus:
    """A paper of one sentence for each customer."""
    rows = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.expr(text).alias("text"), F.lit(1).alias("div"), F.lit(1).alias("p"), F.lit(1).alias("s"), F.col("c_custkey").cast("bigint").alias("seq"))
    return Corpus.of(spark, full_text=text_table(rows))


@query(
    "SELECT CAST(c_custkey AS VARCHAR) AS id, (c_custkey % 4 = 0)::BIGINT AS open, (c_custkey % 4 IN (1, 3))::BIGINT AS closed, (c_custkey % 4 = 2)::BIGINT AS unfound FROM customer"
)
def osf_check_summary(spark: SparkSession, d: str) -> DataFrame:
    """Whether the project that each paper names can be opened, is private or may not be seen, or isn't there."""
    # A project of each paper's own: five signs hold 60 million numbers if letters are digits.
    own = "lpad(lower(conv(c_custkey, 10, 36)), 5, '0')"
    papers = _customers(spark, d, f"'Data are at osf.io/' || {own} || ' for all.'")
    k, key = F.col("c_custkey") % 4, F.expr(own)
    body = F.concat(F.lit('{"data": {"type": "nodes", "attributes": {"title": "A", "public": '), F.when(k == 0, "true").otherwise("false"), F.lit('}, "id": "'), key, F.lit('"}}'))
    answers = read(spark, d, "customer").where(k != 2).select(F.concat(F.lit(f"{settings.osf_api}/nodes/"), key).alias("url"), F.when(k == 3, 401).otherwise(200).alias("status"), body.alias("body"))
    summary = module_run(papers, "osf_check", client=Answers(answers)).summary
    return summary.select("id", *(F.col(f"`osf.{s}`").alias(s) for s in ("open", "closed", "unfound")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 'https://aspredicted.org/k' || c_custkey AS text, replace(c_name, '#', ' ') AS AP_title, 'Answer 8' AS AP_sample_size FROM customer")
def aspredicted_answers(spark: SparkSession, d: str) -> DataFrame:
    papers = _customers(spark, d, "'See <https://aspredicted.org/k' || c_custkey || '> for it.'")
    body = "".join(f"<p>{h}</p><div>Answer {k}</div>" for k, h in enumerate(AP_SECTIONS.values()))
    page = F.concat(F.lit("<html><body><h3><b><i>"), F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit(f"</i></b></h3>{body}</body></html>"))
    pages = read(spark, d, "customer").select(F.concat(F.lit("https://aspredicted.org/k"), F.col("c_custkey").cast("string")).alias("url"), F.lit(200).alias("status"), page.alias("body"))
    return module_run(papers, "aspredicted", client=Answers(pages)).table.select("id", "text", "AP_title", "AP_sample_size")


@query("SELECT CAST(c_custkey AS VARCHAR) AS xref_id, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN '10.5/have' WHEN c_custkey % 3 = 0 THEN '10.6/' || c_custkey END AS doi FROM customer")
def references_with_dois(spark: SparkSession, d: str) -> DataFrame:
    """References that have a DOI keep it; of the others, those that a bibliography has get one."""
    customers = read(spark, d, "customer")
    bib = customers.select(F.col("c_custkey").cast("string").alias("xref_id"), F.col("c_name").alias("title"), F.lit("J").alias("journal"), F.when(F.col("c_custkey") % 2 == 0, "10.5/have").alias("doi"))
    works = customers.where("c_custkey % 3 = 0").select(F.concat(F.lit("10.6/"), F.col("c_custkey").cast("string")).alias("doi"), F.upper("c_name").alias("title"), F.lit("j").alias("source"))
    return add_dois(bib, works).select("xref_id", "title", "doi")


@query(
    """SELECT c_custkey, n_name AS text, CASE WHEN n_nationkey <> 3 THEN 'About ' || n_name END AS answer, CASE WHEN n_nationkey <> 3 THEN CASE WHEN row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) = 1 THEN length(n_name) ELSE 0 END END AS tokens
FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def chat_answers(spark: SparkSession, d: str) -> DataFrame:
    """Each nation was asked for once, and is answered for all its customers; the first has the tokens. One nation was never asked for."""
    nations = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("text"))
    answers = nations.where("c_nationkey <> 3").select(F.col("text").alias("asked"), F.concat(F.lit("About "), "text").alias("answer"), F.length("text").alias("tokens"))
    table = read(spark, d, "customer").select("c_custkey", "c_nationkey").join(nations, "c_nationkey").drop("c_nationkey")
    return ask(table, "What is it?", answers=answers).select("c_custkey", "text", "answer", "tokens")


@query("SELECT c_custkey, 'https://researchbox.org/' || c_custkey AS rb_url, CASE WHEN c_custkey % 5 = 0 THEN 'unfound' END AS error, CASE WHEN c_custkey % 5 > 0 THEN 'data.csv' END AS name, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS description FROM customer")
def researchbox_files(spark: SparkSession, d: str) -> DataFrame:
    """What boxes have in them; some were moved, and some are gone."""
    customers, box = read(spark, d, "customer"), lambda c: F.concat(F.lit("https://researchbox.org/"), c.cast("string"))
    k = F.col("c_custkey")
    page = F.concat(F.lit('<html><body><p class="file_name">data.csv</p><p class="preview_link">'), "c_mktsegment", F.lit("</p></body></html>"))
    moved = customers.where("c_custkey % 5 = 1").select(box(k).alias("url"), F.lit(200).alias("status"), F.concat(F.lit("<script>window.location.replace('"), box(k + 10**8), F.lit("')</script>")).alias("body"))
    whole = customers.where("c_custkey % 5 > 0").select(box(F.when(k % 5 == 1, k + 10**8).otherwise(k)).alias("url"), F.lit(200).alias("status"), page.alias("body"))
    found = rbox_retrieve(customers.select("c_custkey", box(k).alias("rb_url")), client=Answers(moved.unionByName(whole)))
    return found.select("c_custkey", "rb_url", "error", F.get("files", F.lit(0))["name"].alias("name"), F.get("files", F.lit(0))["description"].alias("description"))
