"""Queries over the test tables, one or more for each operator, with the same queries in SQL.

The tables hold no papers, so they stand in for some: a document's lines are paragraphs, its short lines headers; a conversation
is a paper with a section for each role and a paragraph for each turn; reported statistics are made from integers of lineitem.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids, porter
from .functions.json_columns import json_expand
from .functions.text import WORD, words
from .operators import features, sections, tables, validation
from .operators.search import expand_text, search_text
from .operators.statcheck import stats
from .plans import builtin
from .plans.modules import module_run
from .schemas import Corpus, text_table
from .sources.databases import compact_retractions
from .sources.osf import osf_links
from .sources.preregistrations import aspredicted_links, rbox_links
from .sources.reader import corpus_of, parse_files
from .sources.scholarly import abstracts
from .streaming.files import shared_dir, stream_counts, text_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its name, with its SQL if SQL can express it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- stand-ins for papers


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return sections.lines(read(spark, d, "documents"))


LINES = """
l0 AS (SELECT CAST(doc_id AS VARCHAR) AS id, (generate_subscripts(l, 1) - 1)::BIGINT AS seq, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
l1 AS (SELECT *, length(text) <= 20 AS h FROM l0 WHERE text <> ''),
l2 AS (SELECT id, seq, text, nullif(sum(h::INT) OVER w, 0)::INT AS div, last_value(CASE WHEN h THEN text END IGNORE NULLS) OVER w AS header
  FROM l1 WINDOW w AS (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lines AS (SELECT *, (row_number() OVER (PARTITION BY id, div ORDER BY seq) - 1)::INT AS p FROM l2)"""


def talks(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("id"), F.col("role").alias("section"), F.expr("turn div 2").cast("int").alias("div"), F.col("turn").cast("int").alias("p"), F.posexplode(F.split("text", "\n")).alias("at", "text")
    )
    return text_table(rows.withColumn("s", F.col("at") + 1).withColumn("seq", F.col("p").cast("bigint") * 100_000 + F.col("at")).drop("at"))


TALKS = """
t0 AS (SELECT CAST(conv_id AS VARCHAR) AS id, role AS section, (turn // 2)::INT AS div, turn::INT AS p, generate_subscripts(l, 1)::INT AS s, unnest(l) AS text FROM (SELECT *, string_split(text, chr(10)) AS l FROM conversations)),
talks AS (SELECT *, p::BIGINT * 100000 + s - 1 AS seq FROM t0)"""


def reported(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with statistics, made from whole numbers."""
    q, k = F.col("l_quantity").cast("bigint").cast("string"), lambda c, m: (F.col(c) % m).cast("string")
    text = (
        F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("A t("), F.col("l_linenumber").cast("string"), F.lit(") = "), q, F.lit(".5, p < .0"), k("l_partkey", 10), F.lit(", d = 0.5")))
        .when(F.col("l_suppkey") % 4 == 1, F.concat(F.lit("An F(2, 30) = "), q, F.lit(".1, p = .04"), k("l_partkey", 10), F.lit(" and p>.3")))
        .when(F.col("l_suppkey") % 4 == 2, F.concat(F.lit("With t = "), q, F.lit(" and p = n.s. here")))
        .otherwise(F.concat(F.lit("No tests, "), q))
    )
    rows = read(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 100).cast("string").alias("id"), F.col("l_linenumber").alias("div"), (F.col("l_partkey") % 1000).cast("int").alias("p"), F.col("l_orderkey").cast("int").alias("s"), text.alias("text"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return text_table(rows)


REPORTED = """
reported AS (
  SELECT CAST(l_orderkey % 100 AS VARCHAR) AS id, l_linenumber AS div, (l_partkey % 1000)::INT AS p, l_orderkey::INT AS s,
    CASE WHEN l_suppkey % 4 = 0 THEN 'A t(' || l_linenumber || ') = ' || l_quantity::BIGINT || '.5, p < .0' || l_partkey % 10 || ', d = 0.5'
         WHEN l_suppkey % 4 = 1 THEN 'An F(2, 30) = ' || l_quantity::BIGINT || '.1, p = .04' || l_partkey % 10 || ' and p>.3'
         WHEN l_suppkey % 4 = 2 THEN 'With t = ' || l_quantity::BIGINT || ' and p = n.s. here'
         ELSE 'No tests, ' || l_quantity::BIGINT END AS text
  FROM lineitem)"""


def squeezed(x: str) -> str:
    return rf"replace(regexp_replace({x}, '\s+', ' ', 'g'), ' , ', ', ')"


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


# ---------------------------------------------------------------- search


@query(f"WITH {LINES} SELECT DISTINCT id, header, div, p, {squeezed('text')} AS text FROM lines WHERE regexp_matches(text, '[0-9]')")
def search_sentence(spark: SparkSession, d: str) -> DataFrame:
    return search_text(doc_lines(spark, d), "[0-9]").select("id", "header", "div", "p", "text")


@query(f"WITH {LINES} SELECT id, div, p, unnest(regexp_extract_all(text, '[0-9]+')) AS text FROM lines")
def search_match(spark: SparkSession, d: str) -> DataFrame:
    return search_text(doc_lines(spark, d), "[0-9]+", return_="match").select("id", "div", "p", "text")


@query(f"WITH {LINES} SELECT DISTINCT id, div, p, {squeezed('text')} AS text FROM lines WHERE contains(text, '=')")
def search_fixed(spark: SparkSession, d: str) -> DataFrame:
    return search_text(doc_lines(spark, d), "=", fixed=True).select("id", "div", "p", "text")


HIT = "regexp_matches(text, '(?i)tion[a-z]')"
PATTERN = "tion[a-z]"
PARAGRAPHS = f"""parts AS (SELECT id, section, div, p, {squeezed("string_agg(text, ' ' ORDER BY seq)")} AS text, min(seq) AS seq FROM talks GROUP BY ALL)"""


@query(f"WITH {TALKS}, {PARAGRAPHS} SELECT id, section, div, p, text FROM parts WHERE (id, section, div, p) IN (SELECT (id, section, div, p) FROM talks WHERE {HIT})")
def search_paragraph(spark: SparkSession, d: str) -> DataFrame:
    return search_text(talks(spark, d), PATTERN, return_="paragraph").select("id", "section", "div", "p", "text")


def _wider(keys: str) -> str:
    return f"""WITH {TALKS}, {PARAGRAPHS} SELECT {keys}, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS text FROM parts
WHERE ({keys}) IN (SELECT ({keys}) FROM talks WHERE {HIT}) GROUP BY {keys}"""


@query(_wider("id, section, div"))
def search_div(spark: SparkSession, d: str) -> DataFrame:
    return search_text(talks(spark, d), PATTERN, return_="div").select("id", "section", "div", "text")


@query(_wider("id, section"))
def search_section(spark: SparkSession, d: str) -> DataFrame:
    return search_text(talks(spark, d), PATTERN, return_="section").select("id", "section", "text")


@query(_wider("id"))
def search_id(spark: SparkSession, d: str) -> DataFrame:
    return search_text(talks(spark, d), PATTERN, return_="id").select("id", "text")


@query(f"WITH {TALKS} SELECT DISTINCT id, p, s, {squeezed('text')} AS text FROM talks WHERE section = 'assistant' AND regexp_matches(text, '(?i)the') AND regexp_matches(text, '(?i)ment|ing')")
def search_chain(spark: SparkSession, d: str) -> DataFrame:
    return search_text(search_text(talks(spark, d), "the", section="assistant"), "ment|ing").select("id", "p", "s", "text")


@query(rf"WITH {LINES} SELECT DISTINCT id, p, div, {squeezed('text')} AS text FROM lines WHERE regexp_matches(text, '(?i)the (?:\w+\s+){{0,2}}and ')")
def phrase_flag(spark: SparkSession, d: str) -> DataFrame:
    return search_text(doc_lines(spark, d), r"the (?:\w+\s+){0,2}and ").select("id", "p", "div", "text")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,6}"


@query(f"WITH {LINES} SELECT id, p, div, unnest(regexp_extract_all(text, '{EMAIL}')) AS text FROM lines")
def email_extract(spark: SparkSession, d: str) -> DataFrame:
    return search_text(doc_lines(spark, d), EMAIL, return_="match", ignore_case=False).select("id", "p", "div", "text")


@query(f"SELECT CAST(page_id AS VARCHAR) AS id, unnest(regexp_extract_all(url, '(?i){builtin.URL}')) AS text FROM pages")
def url_extract(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("text"))
    return module_run(Corpus.of(spark, full_text=pages), "all_urls").table.select("id", "text")


# ---------------------------------------------------------------- context

FOUND = f"found AS (SELECT DISTINCT id, section, div, p, s, {squeezed('text')} AS text FROM talks WHERE regexp_matches(text, '(?i)thing'))"


@query(
    f"""WITH {TALKS}, {FOUND}
SELECT f.id, f.p, f.s, f.text, string_agg({squeezed("t.text")}, ' ' ORDER BY t.s) AS expanded
FROM found f JOIN talks t ON t.id = f.id AND t.section = f.section AND t.div = f.div AND t.p = f.p AND t.s BETWEEN f.s - 1 AND f.s + 1
GROUP BY f.id, f.p, f.s, f.text"""
)
def expand_sentence_plusminus(spark: SparkSession, d: str) -> DataFrame:
    text = talks(spark, d)
    return expand_text(search_text(text, "thing"), text, plus=1, minus=1).select("id", "p", "s", "text", "expanded")


SQUEEZED_TALKS = f"squeezed AS (SELECT id, section, div, p, s, {squeezed('text')} AS text, seq FROM talks)"


@query(
    f"""WITH {TALKS}, {FOUND}, {SQUEEZED_TALKS}, whole AS (SELECT id, section, div, p, string_agg(text, ' ' ORDER BY seq) AS expanded FROM squeezed GROUP BY ALL)
SELECT f.id, f.p, f.s, f.text, expanded FROM found f JOIN whole USING (id, section, div, p)"""
)
def expand_paragraph(spark: SparkSession, d: str) -> DataFrame:
    text = talks(spark, d)
    return expand_text(search_text(text, "thing"), text, "paragraph").select("id", "p", "s", "text", "expanded")


@query(
    f"""WITH {TALKS}, {FOUND}, {SQUEEZED_TALKS}, part AS (SELECT id, section, div, p, string_agg(text, ' ' ORDER BY seq) AS t, min(seq) AS seq FROM squeezed GROUP BY ALL),
whole AS (SELECT id, section, string_agg(t, chr(10) || chr(10) ORDER BY seq) AS expanded FROM part GROUP BY ALL)
SELECT f.id, f.p, f.s, f.text, expanded FROM found f JOIN whole USING (id, section)"""
)
def expand_section(spark: SparkSession, d: str) -> DataFrame:
    text = talks(spark, d)
    return expand_text(search_text(text, "thing"), text, "section").select("id", "p", "s", "text", "expanded")


@query(f"WITH {TALKS}, {FOUND} SELECT id, p, s, text, text AS expanded FROM found")
def expand_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Places that are not found: the rows keep their own text."""
    text = talks(spark, d)
    lost = search_text(text, "thing").withColumn("div", F.lit(None).cast("int"))
    return expand_text(lost, text).select("id", "p", "s", "text", "expanded")


# ---------------------------------------------------------------- modules

P_MATCHES = rf"""p_matches AS (SELECT id, div, s, unnest(regexp_extract_all(text, '{quoted(builtin.P_VALUE)}')) AS text FROM reported),
p_values AS (SELECT *, regexp_extract(text, '[{builtin.OPERATORS}]{{1,2}}') AS p_comp,
  TRY_CAST(regexp_replace(regexp_replace(regexp_extract(text, '[{builtin.OPERATORS}]{{1,2}}\s*([^{builtin.OPERATORS}]*)$', 1), '\s', '', 'g'), '[x*]10\^', 'e', 'g') AS DOUBLE) AS p_value FROM p_matches),
judged AS (SELECT *, coalesce(p_comp = '<' AND p_value > 0.001, false) OR p_comp NOT IN ('=', '<') OR p_value IS NULL AS imprecise FROM p_values)"""
REPORTED_IDS = "ids AS (SELECT DISTINCT id FROM reported)"


@query(f"WITH {REPORTED}, {P_MATCHES} SELECT id, div, s, text, p_comp, p_value FROM p_values")
def pvalue_extract(spark: SparkSession, d: str) -> DataFrame:
    return module_run(Corpus.of(spark, full_text=reported(spark, d)), "all_p_values").table.select("id", "div", "s", "text", "p_comp", "p_value")


@query(
    f"""WITH {REPORTED}, {P_MATCHES}, {REPORTED_IDS}, n AS (SELECT id, count(*) FILTER (WHERE NOT imprecise) AS exact_p, count(*) FILTER (WHERE imprecise) AS imprecise_p FROM judged GROUP BY id)
SELECT id, coalesce(exact_p, 0) AS exact_p, coalesce(imprecise_p, 0) AS imprecise_p FROM ids LEFT JOIN n USING (id)"""
)
def exact_p_summary(spark: SparkSession, d: str) -> DataFrame:
    return module_run(Corpus.of(spark, full_text=reported(spark, d)), "exact_p").summary


@query(
    f"""WITH {REPORTED}, {P_MATCHES}, {REPORTED_IDS}, n AS (SELECT id, count(*) AS p_values, count(*) FILTER (WHERE NOT imprecise) AS exact_p, count(*) FILTER (WHERE imprecise) AS imprecise_p FROM judged GROUP BY id)
SELECT id, coalesce(p_values, 0) AS p_values, coalesce(exact_p, 0) AS exact_p, coalesce(imprecise_p, 0) AS imprecise_p FROM ids LEFT JOIN n USING (id)"""
)
def chain_summary(spark: SparkSession, d: str) -> DataFrame:
    return module_run(module_run(Corpus.of(spark, full_text=reported(spark, d)), "all_p_values"), "exact_p").summary


def _effects(kind: str, test: str, effect: str) -> str:
    joined = lambda p: f"array_to_string(regexp_extract_all(text, '{quoted(p)}'), '; ')"
    return f"""SELECT id, div, p, s, {squeezed("text")} AS text, nullif({joined("(?i)" + effect)}, '') AS es, {joined(test)} AS test_text, '{kind}' AS test
FROM reported WHERE contains(text, '=') AND regexp_matches(text, '[0-9]') AND regexp_matches(text, '{quoted(test)}')"""


EFFECTS = f"effects AS ({_effects('t-test', builtin.T_TEST, builtin.T_EFFECTS)} UNION ALL {_effects('F-test', builtin.F_TEST, builtin.F_EFFECTS)})"


@query(f"WITH {REPORTED}, {EFFECTS} SELECT id, div, p, s, text, es, test_text, test FROM effects")
def effect_size_table(spark: SparkSession, d: str) -> DataFrame:
    return module_run(Corpus.of(spark, full_text=reported(spark, d)), "effect_size").table.select("id", "div", "p", "s", "text", "es", "test_text", "test")


@query(
    f"""WITH {REPORTED}, {EFFECTS}, {REPORTED_IDS} SELECT id,
  count(*) FILTER (WHERE test = 't-test' AND es IS NOT NULL) AS ttests_with_es, count(*) FILTER (WHERE test = 't-test' AND es IS NULL) AS ttests_without_es,
  count(*) FILTER (WHERE test = 'F-test' AND es IS NOT NULL) AS "Ftests_with_es", count(*) FILTER (WHERE test = 'F-test' AND es IS NULL) AS "Ftests_without_es"
FROM ids LEFT JOIN effects USING (id) GROUP BY id"""
)
def effect_size_summary(spark: SparkSession, d: str) -> DataFrame:
    return module_run(Corpus.of(spark, full_text=reported(spark, d)), "effect_size").summary


def _references(spark: SparkSession, d: str) -> Corpus:
    bib = read(spark, d, "customer").select((F.col("c_custkey") % 25).cast("string").alias("id"), F.col("c_custkey").cast("string").alias("xref_id"), F.col("c_name").alias("ref"))
    key = F.col("o_custkey") + 7 * (F.col("o_orderkey") % 3)
    xrefs = read(spark, d, "orders").select((F.col("o_custkey") % 25).cast("string").alias("id"), key.cast("string").alias("xref_id"), F.col("o_orderpriority").alias("text"))
    return Corpus.of(spark, info=bib.select("id").distinct(), bib=bib, xrefs=xrefs)


REFERENCES = """bib AS (SELECT CAST(c_custkey % 25 AS VARCHAR) AS id, CAST(c_custkey AS VARCHAR) AS xref_id, c_name AS ref FROM customer),
xrefs AS (SELECT CAST(o_custkey % 25 AS VARCHAR) AS id, CAST(o_custkey + 7 * (o_orderkey % 3) AS VARCHAR) AS xref_id, o_orderpriority AS text FROM orders),
unmatched AS (SELECT id, xref_id, ref, 'xrefs' AS missing FROM bib WHERE (id, xref_id) NOT IN (SELECT (id, xref_id) FROM xrefs)
  UNION ALL SELECT id, xref_id, text, 'bib' FROM xrefs WHERE (id, xref_id) NOT IN (SELECT (id, xref_id) FROM bib))"""


@query(f"WITH {REFERENCES} SELECT id, xref_id, ref, missing FROM unmatched")
def ref_consistency_table(spark: SparkSession, d: str) -> DataFrame:
    return module_run(_references(spark, d), "ref_consistency").table.select("id", "xref_id", "ref", "missing")


@query(
    f"""WITH {REFERENCES}, ids AS (SELECT DISTINCT id FROM bib)
SELECT id, (SELECT count(*) FROM bib b WHERE b.id = ids.id) AS n_bib, (SELECT count(*) FROM xrefs x WHERE x.id = ids.id) AS n_xrefs,
  (SELECT count(*) FROM unmatched u WHERE u.id = ids.id AND missing = 'bib') AS missing_bib, (SELECT count(*) FROM unmatched u WHERE u.id = ids.id AND missing = 'xrefs') AS missing_xrefs
FROM ids"""
)
def ref_consistency_summary(spark: SparkSession, d: str) -> DataFrame:
    return module_run(_references(spark, d), "ref_consistency").summary


def _flagged(spark: SparkSession, d: str) -> tuple[Corpus, DataFrame]:
    """References, every citation of them, and a database of DOIs."""
    bib = read(spark, d, "orders").select((F.col("o_orderkey") % 50).cast("string").alias("id"), F.col("o_orderkey").cast("string").alias("xref_id"), F.concat(F.lit("10.1/"), F.col("o_custkey").cast("string")).alias("doi"), F.col("o_orderstatus").alias("ref"))
    xrefs = read(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 50).cast("string").alias("id"), F.col("l_orderkey").cast("string").alias("xref_id"), F.lit("bibr").alias("type"), F.lit("x").alias("contents"), F.col("l_returnflag").alias("text"),
        F.lit("intro").alias("section"), F.lit(1).alias("div"), F.lit(1).alias("p"), F.col("l_linenumber").alias("s"),
    )
    db = read(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("10.1/"), F.col("c_custkey").cast("string")).alias("doi"), F.col("c_mktsegment").alias("retractionwatch"))
    return Corpus.of(spark, info=bib.select("id").distinct(), bib=bib, xrefs=xrefs), db


FLAGGED = """bib AS (SELECT CAST(o_orderkey % 50 AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS xref_id, '10.1/' || o_custkey AS doi, o_orderstatus AS ref FROM orders),
xrefs AS (SELECT CAST(l_orderkey % 50 AS VARCHAR) AS id, CAST(l_orderkey AS VARCHAR) AS xref_id, l_returnflag AS text, l_linenumber AS s FROM lineitem),
db AS (SELECT '10.1/' || c_custkey AS doi, c_mktsegment AS retractionwatch FROM customer WHERE c_acctbal < 0),
flagged AS (SELECT id, xref_id, doi, retractionwatch, text, s FROM bib JOIN db USING (doi) LEFT JOIN xrefs USING (id, xref_id))"""
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _retraction_flags(spark: SparkSession, d: str) -> DataFrame:
    """Every place that cites a flagged reference."""
    corpus, db = _flagged(spark, d)
    return module_run(corpus, "retractionwatch", db=db).table.select("id", "xref_id", "doi", "retractionwatch", "text", "s")


def _retraction_summary(spark: SparkSession, d: str) -> DataFrame:
    """The same, counted; kinds that small tables lack count 0."""
    corpus, db = _flagged(spark, d)
    summary = module_run(corpus, "retractionwatch", db=db).summary
    return summary.withColumns({f"rw_{s}": F.lit(0).cast("bigint") for s in SEGMENTS if f"rw_{s}" not in summary.columns})


def _miscitation_table(spark: SparkSession, d: str) -> DataFrame:
    corpus, db = _flagged(spark, d)
    db = db.select("doi", F.lit("a paper").alias("reftext"), F.col("retractionwatch").alias("warning"))
    return builtin.miscited(corpus, db).select("id", "xref_id", "doi", "text", "s").distinct()


# Each under two names, the second from when the first took a part of the citations.
for _name, _f, _sql in (
    ("retraction_flags", _retraction_flags, f"WITH {FLAGGED} SELECT id, xref_id, doi, retractionwatch, text, s FROM flagged"),
    ("retraction_summary", _retraction_summary, f"""WITH {FLAGGED} SELECT b.id, {", ".join(f"count(*) FILTER (WHERE retractionwatch = '{s}') AS " + f'"rw_{s}"' for s in SEGMENTS)}
FROM (SELECT DISTINCT id FROM bib) b LEFT JOIN flagged USING (id) GROUP BY b.id"""),
    ("miscitation_table", _miscitation_table, f"WITH {FLAGGED} SELECT DISTINCT id, xref_id, doi, text, s FROM flagged"),
):
    for _n in (_name, f"{_name}_whole"):
        QUERIES[_n], SQL[_n] = _f, _sql


@query(
    "SELECT CAST(user_id AS VARCHAR) AS id, "
    + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in ("click", "error", "purchase", "signup", "view"))
    + " FROM events GROUP BY user_id"
)
def event_pivot(spark: SparkSession, d: str) -> DataFrame:
    return builtin.pivot_counts(read(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), "event_type"), "event_type", "n_")


# ---------------------------------------------------------------- reading


@query(f"WITH {LINES} SELECT id, seq, header, div, p FROM lines")
def header_fill(spark: SparkSession, d: str) -> DataFrame:
    return doc_lines(spark, d).select("id", "seq", "header", "div", "p")


HEADERS = ["Abstract", "Some text", "Introduction", "More", "Materials and Methods", "[div-05]", "Results", "General Discussion", "End"]


def _headed(spark: SparkSession, d: str) -> DataFrame:
    header = F.get(F.array(*map(F.lit, HEADERS)), ((F.col("turn") * 5 + F.col("conv_id")) % len(HEADERS)).cast("int"))
    text = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Table 3 "), "role")).otherwise(F.col("role"))
    rows = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("id"), header.alias("header"), text.alias("text"), F.col("turn").cast("int").alias("div"), F.col("turn").alias("seq"))
    return text_table(rows.withColumn("section", F.when(F.col("div") == 6, "annex")).withColumn("p", F.lit(1)).withColumn("s", F.lit(1)))


@query(
    f"""WITH h AS (SELECT CAST(conv_id AS VARCHAR) AS id, turn::BIGINT AS seq, turn::INT AS div, ([{", ".join(f"'{x}'" for x in HEADERS)}])[((turn * 5 + conv_id) % {len(HEADERS)})::INT + 1] AS header,
  CASE WHEN conv_id % 3 = 0 THEN 'Table 3 ' || role ELSE role END AS text, CASE WHEN turn = 6 THEN 'annex' END AS preset FROM conversations),
n AS (SELECT *, header = 'Abstract' AS abstract, coalesce(preset, CASE header WHEN 'Results' THEN 'results' WHEN 'General Discussion' THEN 'discussion' WHEN 'Materials and Methods' THEN 'method' WHEN 'Introduction' THEN 'intro' WHEN 'Abstract' THEN 'abstract' END) AS named FROM h),
b AS (SELECT *, min(CASE WHEN named <> 'abstract' THEN seq END) OVER (PARTITION BY id) AS start FROM n),
i AS (SELECT *, CASE WHEN header = '[div-05]' AND starts_with(text, 'Table 3') THEN 'table' WHEN seq < start AND NOT abstract THEN 'intro' ELSE named END AS sec FROM b),
g AS (SELECT *, sum(abstract::INT) OVER (PARTITION BY id ORDER BY seq) AS grp FROM i)
SELECT id, seq, CASE WHEN abstract THEN sec ELSE coalesce(sec, last_value(CASE WHEN NOT abstract THEN sec END IGNORE NULLS) OVER (PARTITION BY id, grp ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS section FROM g"""
)
def section_locf(spark: SparkSession, d: str) -> DataFrame:
    return sections.classify_sections(_headed(spark, d)).select("id", "seq", "section")


@query(f"WITH {TALKS}, x AS (SELECT id, text, min(seq) AS seq FROM talks GROUP BY ALL) SELECT id, text, section, div, p, s FROM x JOIN talks USING (id, text, seq)")
def xref_locate(spark: SparkSession, d: str) -> DataFrame:
    text = talks(spark, d)
    xrefs = text.select("id", "text").distinct().withColumns({c: F.lit(None).cast("string") for c in ("xref_id", "type", "contents", "section", "div", "p", "s")})
    return sections.locate_xrefs(xrefs, text).select("id", "text", "section", "div", "p", "s")


def _papers(spark: SparkSession, d: str) -> Corpus:
    k = F.col("doc_id") % 5
    docs = read(spark, d, "documents")
    doi = F.when(k == 0, "").when(k == 1, "10.1/bad").otherwise(F.concat(F.lit("10.1234/x."), F.col("doc_id").cast("string")))
    title = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 7 == 1, "Corrigendum: a").when(F.col("doc_id") % 7 == 2, "A Reply To b").otherwise(F.concat(F.lit("On "), "source"))
    info = docs.select(F.col("doc_id").cast("string").alias("id"), title.alias("title"), F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("lang")).alias("description"), doi.alias("doi"), F.array("lang", "source").alias("keywords"))
    bib = docs.where("n_chars > 500").select(F.col("doc_id").cast("string").alias("id"), F.lit("b1").alias("xref_id"))
    return Corpus.of(spark, info=info, bib=bib)


PAPERS = """papers AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN 'Corrigendum: a' WHEN doc_id % 7 = 2 THEN 'A Reply To b' ELSE 'On ' || source END AS title,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE lang END AS description, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '10.1/bad' ELSE '10.1234/x.' || doc_id END AS doi, lang || '; ' || source AS keywords, (n_chars > 500)::BIGINT AS bib FROM documents)"""


@query(f"WITH {PAPERS} SELECT id, title, keywords, doi, NULL::VARCHAR AS received FROM papers")
def info_columns(spark: SparkSession, d: str) -> DataFrame:
    return tables.info_table(_papers(spark, d), ["title", "keywords", "doi", "received"])


@query(
    f"""WITH {PAPERS}, c AS (SELECT id, CASE WHEN doi = '' THEN 'missing' WHEN NOT regexp_matches(doi, '{ids.DOI}') THEN 'invalid' ELSE '' END AS doi,
  CASE WHEN title = '' THEN 'missing' WHEN contains(lower(title), 'corrigendum') THEN 'corrigendum' WHEN contains(lower(title), 'reply to') THEN 'reply' ELSE '' END AS title, CASE WHEN description = '' THEN 'missing' ELSE '' END AS abstract, bib FROM papers)
SELECT id, doi = '' AND title <> 'missing' AND abstract = '' AND bib > 0 AS valid, doi, title, abstract, bib FROM c"""
)
def paper_check(spark: SparkSession, d: str) -> DataFrame:
    return tables.paper_validate(_papers(spark, d))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS surname, c_mktsegment AS given, 'A, B; C' AS affiliation, 1 AS n FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'second', '', '', 2 FROM customer")
def author_rows(spark: SparkSession, d: str) -> DataFrame:
    person = lambda s, g, a: f"named_struct('orcid', CAST(NULL AS STRING), 'name', named_struct('surname', {s}, 'given', {g}), 'roles', CAST(array() AS ARRAY<STRING>), 'email', CAST(NULL AS STRING), 'affiliation', {a})"
    some, none = "array(map('dep', 'A', 'inst', 'B'), map('inst', 'C'))", "CAST(array() AS ARRAY<MAP<STRING, STRING>>)"
    authors = read(spark, d, "customer").selectExpr("CAST(c_custkey AS STRING) AS id", f"array({person('c_name', 'c_mktsegment', some)}, {person(repr('second'), repr(''), none)}) AS authors")
    return tables.author_table(Corpus.of(spark, info=authors.select("id"), authors=authors)).select("id", "surname", "given", "affiliation", "n")


# ---------------------------------------------------------------- papers in files

CONTROL = r"[\x00-\x1F\x7F]"


def escaped(c) -> Column:
    """A text as XML has it; control characters become spaces."""
    return F.replace(F.replace(F.replace(F.regexp_replace(c, CONTROL, " "), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _tei_papers(spark: SparkSession, d: str) -> Corpus:
    """Each document written as a TEI file (a division for each line, one reference), and read back."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "")
    body = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("<div><head>Part "), (i + 1).cast("string"), F.lit("</head><p>"), escaped(x), F.lit("</p></div>"))), "")
    key = F.col("doc_id").cast("string")
    content = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>On '), "source", F.lit('</title></titleStmt><sourceDesc><biblStruct><idno type="DOI">10.1/'), key,
        F.lit("</idno></biblStruct></sourceDesc></fileDesc><profileDesc><textClass><keywords><term>"), "lang", F.lit("</term><term>"), "source",
        F.lit("</term></keywords></textClass><abstract><p>About "), "lang", F.lit("</p></abstract></profileDesc></teiHeader><text><body>"), body,
        F.lit('</body><back><div type="references"><listBibl><biblStruct xml:id="b0"><analytic><title level="a">Of '), "source",
        F.lit("</title><author><persName><forename>A</forename><surname>"), "lang", F.lit('</surname></persName></author><idno type="DOI">10.2/'), key,
        F.lit('</idno></analytic><monogr><title level="j">Journal</title><imprint><date type="published">'), (1900 + F.col("doc_id") % 100).cast("string"),
        F.lit("</date></imprint></monogr></biblStruct></listBibl></div></back></text></TEI>"),
    )
    files = read(spark, d, "documents").select(F.concat(F.lit("papers/"), key, F.lit(".xml")).alias("path"), content.cast("binary").alias("content"))
    return corpus_of(parse_files(files), files)


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 'On ' || source AS title, lang || '; ' || source AS keywords, '10.1/' || doc_id AS doi, 'About ' || lang AS description FROM documents")
def tei_info(spark: SparkSession, d: str) -> DataFrame:
    return tables.info_table(_tei_papers(spark, d), ["title", "keywords", "doi", "description"])


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS id, 'b0' AS xref_id, '10.2/' || doc_id AS doi, 'article' AS bibtype, 'Of ' || source AS title, 'Journal' AS journal,
  CAST(1900 + doc_id % 100 AS VARCHAR) AS year, 'A ' || lang AS authors FROM documents"""
)
def tei_references(spark: SparkSession, d: str) -> DataFrame:
    return _tei_papers(spark, d).bib.select("id", "xref_id", "doi", "bibtype", "title", "journal", "year", "authors")


PHRASES = ["This was marginally significant", "It approached, then significance", "A trend toward significance here", "Almost fully significant", "Borderline significant it is", "Close to significance", "Plainly significant"]


@query(
    f"""WITH t AS (SELECT CAST(p_partkey % 50 AS VARCHAR) AS id, p_partkey::INT AS p, ([{", ".join(f"'{x}'" for x in PHRASES)}])[(p_partkey % {len(PHRASES)})::INT + 1] AS text FROM part),
h AS (SELECT id, count(*) AS marginal FROM t WHERE regexp_matches(text, '(?i){builtin.MARGINAL}') GROUP BY id)
SELECT DISTINCT id, coalesce(marginal, 0) AS marginal FROM t LEFT JOIN h USING (id)"""
)
def marginal_summary(spark: SparkSession, d: str) -> DataFrame:
    text = F.get(F.array(*map(F.lit, PHRASES)), (F.col("p_partkey") % len(PHRASES)).cast("int"))
    rows = read(spark, d, "part").select((F.col("p_partkey") % 50).cast("string").alias("id"), F.col("p_partkey").cast("int").alias("p"), text.alias("text"), F.col("p_partkey").alias("seq"))
    return module_run(Corpus.of(spark, full_text=text_table(rows)), "marginal").summary


@query(
    f"""WITH {REPORTED}, {P_MATCHES}, {EFFECTS}, {REFERENCES}
SELECT 'exact_p' AS module, CASE WHEN count(*) = 0 THEN 'na' WHEN bool_or(imprecise) THEN 'red' ELSE 'green' END AS light FROM judged
UNION ALL SELECT 'effect_size', CASE WHEN count(*) = 0 THEN 'na' WHEN count(es) = count(*) THEN 'green' WHEN count(es) = 0 THEN 'red' ELSE 'yellow' END FROM effects
UNION ALL SELECT 'marginal', CASE WHEN count(*) FILTER (WHERE regexp_matches(text, '(?i){builtin.MARGINAL}')) > 0 THEN 'red' ELSE 'green' END FROM reported
UNION ALL SELECT 'ref_consistency', CASE WHEN (SELECT count(*) FROM bib) = 0 THEN 'na' WHEN (SELECT count(*) FROM unmatched) = 0 THEN 'green' ELSE 'red' END"""
)
def module_lights(spark: SparkSession, d: str) -> DataFrame:
    """The traffic lights of some modules."""
    papers = Corpus.of(spark, full_text=reported(spark, d))
    lights = [(name, module_run(papers, name).traffic_light) for name in ("exact_p", "effect_size", "marginal")]
    lights.append(("ref_consistency", module_run(_references(spark, d), "ref_consistency").traffic_light))
    return spark.createDataFrame(lights, "module string, light string")


STATS = f"""{REPORTED}, n AS (SELECT *, regexp_extract(text, '= ([0-9]+)', 1) AS q, regexp_extract(text, 'p [<=] (\\.0[0-9]+)', 1) AS pv FROM reported WHERE starts_with(text, 'A t(') OR starts_with(text, 'An F(')),
parts AS (SELECT DISTINCT id, div, p, s, CASE WHEN starts_with(text, 'A t') THEN 't(' || div || ') = ' || q || '.5, p < ' || pv ELSE 'F(2, 30) = ' || q || '.1, p = ' || pv END AS raw,
  CASE WHEN starts_with(text, 'A t') THEN 't' ELSE 'F' END AS test_type, CASE WHEN starts_with(text, 'An') THEN 2.0::DOUBLE END AS df1, CASE WHEN starts_with(text, 'A t') THEN div::DOUBLE ELSE 30.0::DOUBLE END AS df2,
  (q || CASE WHEN starts_with(text, 'A t') THEN '.5' ELSE '.1' END)::DOUBLE AS test_value, pv::DOUBLE AS reported_p FROM n)"""


@query(f"WITH {STATS} SELECT * FROM parts")
def statcheck_parts(spark: SparkSession, d: str) -> DataFrame:
    """What statcheck takes from each reported result, before the tails of distributions."""
    return stats(reported(spark, d)).select("id", "div", "p", "s", "raw", "test_type", "df1", "df2", "test_value", "reported_p")


def _t_tail(x: str) -> str:
    """The two-sided p value of t with whole degrees of freedom, which has a closed form: sums of sines and cosines of atan(t / sqrt(df))."""
    angle = f"atan(abs({x}) / sqrt(df2))"
    odd = f"2 / pi() * ({angle} + sin({angle}) * list_sum(list_transform(range(1, df2::INT, 2), lambda k: cos({angle}) ** k * list_product([1.0] || list_transform(range(2, k, 2), lambda j: j / (j + 1.0))))))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, df2::INT, 2), lambda k: cos({angle}) ** k * list_product([1.0] || list_transform(range(2, k + 1, 2), lambda j: (j - 1.0) / j))))"
    return f"1 - CASE WHEN df2 = 1 THEN 2 / pi() * {angle} WHEN df2::INT % 2 = 1 THEN {odd} ELSE {even} END"


#: Each value's p; that of F with 2 degrees of freedom above is a power.
TAILS = ", ".join(f"CASE WHEN test_type = 't' THEN {_t_tail(x)} ELSE (1 + 2 * ({x}) / df2) ** (-df2 / 2) END AS {name}" for x, name in (("test_value", "computed"), ("test_value - 0.05", "high"), ("test_value + 0.05", "low")))
JUDGED_STATS = f"""{STATS}, tails AS (SELECT *, {TAILS} FROM parts),
checked AS (SELECT *, CASE WHEN test_type = 't' THEN low >= reported_p OR reported_p = 0 ELSE NOT (reported_p BETWEEN low - 0.0005 - 1e-12 AND high + 0.0005 + 1e-12) END AS error FROM tails),
stat_errors AS (SELECT *, error AND NOT (test_type = 't' AND reported_p > 0.05) AND (reported_p <= 0.05) <> (computed <= 0.05) AS decision_error FROM checked)"""


@query(f"WITH {JUDGED_STATS} SELECT id, div, s, raw, test_type, df1, df2, test_value, reported_p, round(computed, 8) AS computed_p, error, decision_error FROM stat_errors")
def statcheck_table(spark: SparkSession, d: str) -> DataFrame:
    """Tests with recomputed p values, and whether the reported ones agree; SQL has the closed forms that tails of these degrees of freedom have."""
    rows = stats(reported(spark, d)).withColumn("computed_p", F.round("computed_p", 8))
    return rows.select("id", "div", "s", "raw", "test_type", "df1", "df2", "test_value", "reported_p", "computed_p", "error", "decision_error")


# ---------------------------------------------------------------- words

WORDS_SQL = f"regexp_extract_all(lower(text), '{quoted(WORD)}')"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("text", F.col("toxic").alias("classification"))


@query(
    f"""WITH l AS (SELECT text, toxic FROM documents JOIN labels USING (doc_id)), k AS (SELECT count(*) FILTER (WHERE toxic = 0) AS a, count(*) FILTER (WHERE toxic = 1) AS b FROM l),
w AS (SELECT toxic, unnest({WORDS_SQL}) AS word FROM l), v AS (SELECT toxic, CASE WHEN regexp_matches(word, '{features.NUMBER}') THEN '###' ELSE word END AS word FROM w),
c AS (SELECT word, count(*) FILTER (WHERE toxic = 0) AS n_0, count(*) FILTER (WHERE toxic = 1) AS n_1 FROM v WHERE word NOT IN ('the', 'of') GROUP BY word)
SELECT word, n_0, n_1, n_0 + n_1 AS total, n_0 / a AS freq_0, n_1 / b AS freq_1, abs(n_0 / a - n_1 / b) AS difference FROM c, k WHERE n_0 + n_1 >= (a + b) / 10.0
ORDER BY difference DESC, word LIMIT 60"""
)
def distinctive_words(spark: SparkSession, d: str) -> DataFrame:
    return features.distinctive_words(_labelled(spark, d), n=60, stop_words=["the", "of"], stem=False)


def _stem_sql(words: str, more: str = "") -> str:
    """Stems of the distinct words of a table, as common table expressions; the last is stemmed(word, stem, and the columns more)."""
    cut = lambda n: f"left(w, length(w) - {n})"
    like = lambda x, pattern: f"regexp_matches({x}, '{pattern}')"

    def endings(rules: list[tuple[str, str]], measure: str) -> str:
        out = []
        for ending, instead in sorted(rules, key=lambda r: -len(r[0])):
            rest = cut(len(ending))
            more = f" AND {like(rest, '[st]$')}" if (ending, instead) == ("ion", "") else ""
            out.append(f"WHEN ends_with(w, '{ending}') THEN CASE WHEN {like(rest, measure)}{more} THEN {rest} || '{instead}' ELSE w END")
        return f"CASE {' '.join(out)} ELSE w END"

    last = "left(w, length(w) - 1)"
    steps = [
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {like(cut(3), porter.ABOVE_0)} THEN {cut(1)} ELSE w END WHEN ends_with(w, 'ed') AND {like(cut(2), porter.HAS_VOWEL)} THEN {cut(2)} || '+'"
        f" WHEN ends_with(w, 'ing') AND {like(cut(3), porter.HAS_VOWEL)} THEN {cut(3)} || '+' ELSE w END",
        f"CASE WHEN NOT ends_with(w, '+') THEN w WHEN {like('w', '(at|bl|iz).$')} THEN {last} || 'e' WHEN length(w) > 2 AND w[-2] = w[-3] AND {like(last, porter.ENDS_CONSONANT)} AND w[-2] NOT IN ('l', 's', 'z') THEN {cut(2)}"
        f" WHEN {like(last, porter.SHORT)} THEN {last} || 'e' ELSE {last} END",
        f"CASE WHEN ends_with(w, 'y') AND {like(last, porter.HAS_VOWEL)} THEN {last} || 'i' ELSE w END",
        endings(porter.STEP2, porter.ABOVE_0),
        endings(porter.STEP3, porter.ABOVE_0),
        endings([(x, "") for x in porter.STEP4], porter.ABOVE_1),
        f"CASE WHEN ends_with(w, 'e') AND ({like(last, porter.ABOVE_1)} OR {like(last, porter.JUST_1)} AND NOT {like(last, porter.SHORT)}) THEN {last} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {like('w', porter.ABOVE_1)} THEN {last} ELSE w END",
    ]
    out = [f"stem0 AS (SELECT DISTINCT word, word AS w{more} FROM {words})"]
    out += [f"stem{k} AS (SELECT word{more}, CASE WHEN length(word) < 3 THEN word ELSE {step} END AS w FROM stem{k - 1})" for k, step in enumerate(steps, 1)]
    return ", ".join([*out, f"stemmed AS (SELECT word, w AS stem{more} FROM stem{len(steps)})"])


@query(
    f"""WITH l AS (SELECT text, toxic FROM documents JOIN labels USING (doc_id)), k AS (SELECT count(*) FILTER (WHERE toxic = 0) AS a, count(*) FILTER (WHERE toxic = 1) AS b FROM l),
w AS (SELECT toxic, unnest({WORDS_SQL}) AS word FROM l), v AS (SELECT toxic, CASE WHEN regexp_matches(word, '{features.NUMBER}') THEN '###' ELSE word END AS word FROM w),
n AS (SELECT word, count(*) FILTER (WHERE toxic = 0) AS n_0, count(*) FILTER (WHERE toxic = 1) AS n_1 FROM v GROUP BY word), {_stem_sql("n", ", n_0, n_1")},
c AS (SELECT stem AS word, sum(n_0)::BIGINT AS n_0, sum(n_1)::BIGINT AS n_1 FROM stemmed GROUP BY stem)
SELECT word, n_0, n_1, n_0 + n_1 AS total, n_0 / a AS freq_0, n_1 / b AS freq_1, abs(n_0 / a - n_1 / b) AS difference FROM c, k WHERE n_0 + n_1 >= (a + b) / 10.0
ORDER BY difference DESC, word LIMIT 60"""
)
def distinctive_stems(spark: SparkSession, d: str) -> DataFrame:
    return features.distinctive_words(_labelled(spark, d), n=60)


@query(
    f"""WITH w AS (SELECT doc_id, text, {WORDS_SQL} AS w FROM documents)
SELECT doc_id, len(w)::INT AS word_count, regexp_matches(text, '[0-9]')::INT AS has_number, contains(text, '=')::INT AS has_equals, {", ".join(f"list_contains(w, '{x}')::INT AS {x}" for x in ("the", "de", "idiot"))} FROM w"""
)
def text_features(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text")
    return features.text_features(docs, ["the", "de", "idiot"], stem=False).drop("text")


@query(f"WITH w AS (SELECT unnest({WORDS_SQL}) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 25")
def top_words(spark: SparkSession, d: str) -> DataFrame:
    each = read(spark, d, "documents").select(F.explode(words(F.col("text"))).alias("word"))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(25)


@query(
    f"""WITH e AS (SELECT doc_id, generate_subscripts(w, 1) AS k, unnest(w) AS word FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)), {_stem_sql("e")},
t AS (SELECT doc_id, string_agg(stem, ' ' ORDER BY k) AS stems FROM e JOIN stemmed USING (word) GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(stems, '') END AS stems FROM documents LEFT JOIN t USING (doc_id)"""
)
def porter_stems(spark: SparkSession, d: str) -> DataFrame:
    found = porter.stem_texts(read(spark, d, "documents"), "doc_id", words(F.col("text")))
    return found.select("doc_id", F.array_join("stems", " ").alias("stems"))


# ---------------------------------------------------------------- validation

EXPECTED = "e AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE quality = 1), o AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE n_chars > 1000)"


@query(f"WITH {EXPECTED} SELECT id, e.id IS NOT NULL AS expected, o.id IS NOT NULL AS observed, e.id IS NOT NULL AND o.id IS NOT NULL AS match FROM e FULL JOIN o USING (id)")
def validate_table(spark: SparkSession, d: str) -> DataFrame:
    expected = read(spark, d, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("id"))
    observed = read(spark, d, "documents").where("n_chars > 1000").select(F.col("doc_id").cast("string").alias("id"))
    return validation.compare_tables(expected, observed)


@query(
    """WITH e AS (SELECT doc_id AS id, quality, toxic FROM labels), o AS (SELECT doc_id AS id, (n_chars > 500)::INT AS quality, 0 AS toxic FROM documents)
SELECT id, e.quality AS quality_expected, e.toxic AS toxic_expected, o.quality AS quality_observed, o.toxic AS toxic_observed,
  e.quality IS NOT DISTINCT FROM o.quality AS quality, e.toxic IS NOT DISTINCT FROM o.toxic AS toxic FROM e FULL JOIN o USING (id)"""
)
def validate_summary(spark: SparkSession, d: str) -> DataFrame:
    expected = read(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    observed = read(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") > 500).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    return validation.compare_summaries(expected, observed)[0]


@query(
    """SELECT count(*) FILTER (WHERE quality = 1 AND n_chars > 500) AS hits, count(*) FILTER (WHERE quality = 1 AND n_chars <= 500) AS misses,
  count(*) FILTER (WHERE quality = 0 AND n_chars > 500) AS false_alarms, count(*) FILTER (WHERE quality = 0 AND n_chars <= 500) AS correct_rejections FROM documents JOIN labels USING (doc_id)"""
)
def accuracy_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id")
    return validation.confusion(rows.select((F.col("quality") == 1).alias("expected"), (F.col("n_chars") > 500).alias("observed")))


#: The normal quantile by Newton's steps; what is below a value by a series of odd powers.
_BELOW = "(0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * z * list_reduce(range(120, 0, -1), lambda so_far, k: 1 + z * z / (2 * k + 1) * so_far, 1.0::DOUBLE))"
_QUANTILE = "CASE WHEN {0} < 0.5 THEN -1 ELSE 1 END * list_reduce(range(0, 40), lambda z, _: z + (greatest({0}, 1 - {0}) - " + _BELOW + ") * sqrt(2 * pi()) * exp(z * z / 2), 0.0::DOUBLE)"


@query(
    f"""WITH c AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND n_chars > 500) AS hits, count(*) FILTER (WHERE quality = 1 AND n_chars <= 500) AS misses,
  count(*) FILTER (WHERE quality = 0 AND n_chars > 500) AS false_alarms, count(*) FILTER (WHERE quality = 0 AND n_chars <= 500) AS correct_rejections FROM documents JOIN labels USING (doc_id) GROUP BY lang),
n AS (SELECT *, hits + misses AS present, false_alarms + correct_rejections AS absent FROM c),
r AS (SELECT *, least(greatest(hits / present, 0.5 / present), 1 - 0.5 / present) AS hit, least(greatest(false_alarms / absent, 0.5 / absent), 1 - 0.5 / absent) AS alarm FROM n),
z AS (SELECT *, {_QUANTILE.format("hit")} AS z_hit, {_QUANTILE.format("alarm")} AS z_alarm FROM r)
SELECT lang, hits, misses, round(hit, 8) AS sensitivity, round(alarm, 8) AS specificity, round((hits + correct_rejections) / (present + absent), 8) AS accuracy,
  round(z_hit - z_alarm, 7) AS d_prime, round(exp((z_alarm ** 2 - z_hit ** 2) / 2), 7) AS beta FROM z"""
)
def accuracy_measures(spark: SparkSession, d: str) -> DataFrame:
    """Signal detection measures for the documents of each language."""
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("expected"), (F.col("n_chars") > 500).alias("observed"))
    columns = {"sensitivity": 8, "specificity": 8, "accuracy": 8, "d_prime": 7, "beta": 7}
    return validation.measures(rows, by=["lang"]).select("lang", "hits", "misses", *(F.round(c, k).alias(c) for c, k in columns.items()))


# ---------------------------------------------------------------- scalar functions


@query("SELECT event_id, CASE WHEN event_id % 9 > 0 THEN CAST(json_extract(props, '$.k') AS INT) END AS k, CASE WHEN event_id % 9 = 0 THEN 'parsing error' END AS error FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    answers = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, "{bad").otherwise(F.col("props")).alias("answer"))
    return json_expand(answers).drop("answer")


ORCID_DIGITS = "'00000' || lpad(CAST((c_custkey * 7919) % 1000000007 AS VARCHAR), 10, '0')"


@query(
    f"""WITH d AS (SELECT c_custkey, {ORCID_DIGITS} AS b, c_custkey % 11 AS c FROM customer),
t AS (SELECT *, (12 - ({" + ".join(f"substr(b, {i}, 1)::INT * {2 ** (16 - i)}" for i in range(1, 16))}) % 11) % 11 AS r FROM d)
SELECT c_custkey, CASE WHEN r = c THEN substr(b, 1, 4) || '-' || substr(b, 5, 4) || '-' || substr(b, 9, 4) || '-' || substr(b, 13, 3) || CASE WHEN c = 10 THEN 'X' ELSE c::VARCHAR END END AS orcid FROM t"""
)
def orcid_check(spark: SparkSession, d: str) -> DataFrame:
    last = F.when(F.col("c_custkey") % 11 == 10, "X").otherwise((F.col("c_custkey") % 11).cast("string"))
    written = F.concat(F.lit("orcid.org/"), F.expr(ORCID_DIGITS.replace("VARCHAR", "STRING")), last)
    return read(spark, d, "customer").select("c_custkey", ids.check_orcid(written).alias("orcid"))


@query(f"SELECT c_custkey, regexp_matches('10.' || c_custkey || '/' || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '.' ELSE '' END, '{ids.DOI}') AS well_formed FROM customer")
def doi_check(spark: SparkSession, d: str) -> DataFrame:
    doi = F.concat(F.lit("10."), F.col("c_custkey").cast("string"), F.lit("/"), "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, ".").otherwise(""))
    return read(spark, d, "customer").select("c_custkey", ids.doi_form(doi).alias("well_formed"))


OSF_FORMS = ["https://osf.io/{}", "osf.io/{}/", "{}", "https://osf.io/ {}", "http://x.org/abc/osf.io/{}?view", "nothing {} here"]


@query(
    f"""WITH r AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 5, 'a') AS k, p_partkey % {len(OSF_FORMS)} AS f FROM part)
SELECT p_partkey, CASE WHEN f = 5 THEN NULL ELSE k END AS osf_id FROM r"""
)
def osf_ids(spark: SparkSession, d: str) -> DataFrame:
    key = F.lpad(F.col("p_partkey").cast("string"), 5, "a")
    form = F.get(F.array(*map(F.lit, OSF_FORMS)), (F.col("p_partkey") % len(OSF_FORMS)).cast("int"))
    return read(spark, d, "part").select("p_partkey", ids.osf_id(F.replace(form, F.lit("{}"), key)).alias("osf_id"))


FILE_TYPE_ROWS: dict[str, list[str]] = {}
for _kind, _exts in ids.FILE_TYPES.items():
    for _ext in _exts.split():
        FILE_TYPE_ROWS.setdefault(_ext, []).append(_kind)
FILE_TYPES_SQL = "types(ext, type) AS (VALUES " + ", ".join(f"('{e}', '{';'.join(k)}')" for e, k in FILE_TYPE_ROWS.items()) + ")"


@query(f"WITH {FILE_TYPES_SQL} SELECT page_id, type AS filetype FROM pages LEFT JOIN types ON lower(regexp_extract(url, '([^.]*)$', 1)) = ext")
def filetype_class(spark: SparkSession, d: str) -> DataFrame:
    return ids.with_filetype(read(spark, d, "pages"), "url").select("page_id", "filetype")


FILES = ["Code_Book.pdf", "data dict.txt", "READ-me.md", "analysis.R", "raw.csv", "notes.pdf", "script.py", "out.spv"]


@query(
    f"""WITH f AS (SELECT p_partkey, ([{", ".join(f"'{x}'" for x in FILES)}])[(p_partkey % {len(FILES)})::INT + 1] AS name FROM part)
SELECT p_partkey, CASE name WHEN 'Code_Book.pdf' THEN 'codebook' WHEN 'data dict.txt' THEN 'codebook' WHEN 'READ-me.md' THEN 'readme' WHEN 'analysis.R' THEN 'code' WHEN 'raw.csv' THEN 'data' WHEN 'script.py' THEN 'code' WHEN 'out.spv' THEN 'code' END AS category FROM f"""
)
def contents_category(spark: SparkSession, d: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, FILES)), (F.col("p_partkey") % len(FILES)).cast("int"))
    files = ids.with_filetype(read(spark, d, "part").select("p_partkey", name.alias("name")))
    return files.select("p_partkey", ids.file_category(F.col("name"), F.col("filetype")).alias("category"))


def _inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """Texts put together again from the positions of their words, which are sorted with their positions, so that each word's are one run."""
    sort = F.sort_array(F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    runs = read(spark, d, "documents").select("doc_id", sort.alias("s"))
    word = lambda i: F.get("s", i)["w"]
    first = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (word(i) != word(i - 1)))
    runs = runs.select("doc_id", "s", F.when(F.col("s").isNotNull(), first).alias("first"))
    length = lambda i, k: F.coalesce(F.get("first", k + 1), F.size("s")) - i
    places = F.transform("first", lambda i, k: F.struct(word(i).alias("w"), F.transform(F.slice("s", i + 1, length(i, k)), lambda x: x["i"]).alias("p")))
    return abstracts(runs.select("doc_id", F.map_from_entries(places).alias("index")), "doc_id", "index")


for _n in ("inverted_index", "inverted_index_whole"):
    QUERIES[_n], SQL[_n] = _inverted_index, "SELECT doc_id, array_to_string(string_split(text, ' '), ' ') AS abstract FROM documents"


@query("SELECT p_brand, p_partkey, p_size FROM (SELECT *, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM part) WHERE t <= 400")
def download_cap(spark: SparkSession, d: str) -> DataFrame:
    return tables.keep_within(read(spark, d, "part").select("p_brand", "p_partkey", "p_size"), "p_size", 400, ["p_brand"], "p_partkey")


@query("SELECT n_name AS name, n_nationkey AS nation, NULL::INT AS region FROM nation UNION ALL SELECT r_name, NULL, r_regionkey FROM region")
def union_fill(spark: SparkSession, d: str) -> DataFrame:
    nations = read(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation"))
    return nations.unionByName(read(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region")), allowMissingColumns=True)


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_of_each(spark: SparkSession, d: str) -> DataFrame:
    return tables.first_of(read(spark, d, "documents").select("text", "doc_id"), ["text"], "doc_id").select("text", "doc_id")


# ---------------------------------------------------------------- links, streams


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """Each customer has two sentences: a link that may be cut, and what follows."""
    key = F.lpad(F.col("c_custkey").cast("string"), 5, "b")
    first = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("See osf.io/"), key, F.lit("/?view_only="))).otherwise(F.concat(F.lit("See OSF.io/ "), key, F.lit(" and more")))
    return read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.explode(F.array(F.struct(F.lit(1).alias("s"), first.alias("text")), F.struct(F.lit(2).alias("s"), F.concat(F.lit("abc"), (F.col("c_custkey") % 7).cast("string"), F.lit(" there")).alias("text")))).alias("x")).select("id", "x.*").withColumn("p", F.lit(1)).withColumn("div", F.lit(1)).withColumn("seq", F.col("s").cast("bigint"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 1 AS s, CASE WHEN c_custkey % 2 = 0 THEN 'osf.io/' || lpad(CAST(c_custkey AS VARCHAR), 5, 'b') || '/?view_only= abc' || c_custkey % 7 ELSE 'OSF.io/ ' || lpad(CAST(c_custkey AS VARCHAR), 5, 'b') END AS text FROM customer")
def osf_link_table(spark: SparkSession, d: str) -> DataFrame:
    return osf_links(_linked(spark, d)).select("id", "s", F.rtrim("text").alias("text"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 1 AS s, 'https://aspredicted.org/' || CASE c_custkey % 3 WHEN 0 THEN 'blind.php?x=k' || c_custkey WHEN 1 THEN 'k' || c_custkey || '.pdf' ELSE 'k' || c_custkey END AS text FROM customer")
def aspredicted_link_table(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("k"), F.col("c_custkey").cast("string"))
    kind = F.col("c_custkey") % 3
    first = F.when(kind == 0, F.lit("At <https://aspredicted.org/blind.php?")).when(kind == 1, F.concat(F.lit("At <https://aspredicted> .org/"), key, F.lit(".pdf)."))).otherwise(F.concat(F.lit("At <https://aspredicted.org/ "), key, F.lit("> now")))
    rows = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.posexplode(F.array(first, F.concat(F.lit(" x = "), key, F.lit("> end")))).alias("s", "text"))
    return aspredicted_links(rows.withColumn("s", F.col("s") + 1).withColumn("p", F.lit(1)).withColumn("seq", F.col("s").cast("bigint"))).select("id", "s", "text")


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS id, 'https://researchbox.org/' || c_custkey % 40 AS text FROM customer"""
)
def rbox_link_table(spark: SparkSession, d: str) -> DataFrame:
    link = F.concat(F.lit("<https://researchbox.org/"), (F.col("c_custkey") % 40).cast("string"), F.lit(">"))
    rows = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("See "), link, F.lit(" and "), link).alias("text"))
    return rbox_links(rows.withColumn("seq", F.col("id").cast("bigint"))).select("id", "text")


@query(
    """WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 > 0 THEN 'id' END AS osf_id, ([NULL, 'nodes', 'private', 'unfound', 'too many requests', 'users'])[(c_custkey % 6)::INT + 1] AS osf_type,
  CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS public FROM customer)
SELECT k, CASE WHEN osf_id IS NULL THEN 'invalid' WHEN osf_type IN ('unfound', 'too many requests') THEN osf_type WHEN osf_type = 'private' OR NOT public THEN 'closed' WHEN public OR osf_type IS NOT NULL THEN 'open' ELSE '' END AS status FROM r"""
)
def osf_states(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.get(F.array(*(F.lit(x) for x in (None, "nodes", "private", "unfound", "too many requests", "users"))), (k % 6).cast("int"))
    rows = read(spark, d, "customer").select(k.alias("k"), F.when(k % 7 > 0, "id").alias("osf_id"), kind.alias("osf_type"), F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("public"))
    return builtin.osf_status(rows).select("k", "status")


@query("SELECT CAST(o_custkey AS VARCHAR) AS doi, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS retractionwatch FROM orders WHERE o_custkey % 9 > 0 GROUP BY o_custkey")
def retraction_compact(spark: SparkSession, d: str) -> DataFrame:
    """The published list of retractions as one row for each paper."""
    doi = F.when(F.col("o_custkey") % 9 == 0, "unavailable").otherwise(F.col("o_custkey").cast("string"))
    return compact_retractions(read(spark, d, "orders").select(doi.alias("OriginalPaperDOI"), F.col("o_orderpriority").alias("RetractionNature")))


@query(
    f"""WITH {TALKS}, {SQUEEZED_TALKS}, whole AS (SELECT id, section, div, p, string_agg(text, ' ' ORDER BY seq) AS expanded FROM squeezed GROUP BY ALL)
SELECT DISTINCT id, section, div, p, expanded FROM squeezed JOIN whole USING (id, section, div, p) WHERE section = 'user' AND regexp_matches(text, '(?i)ing') AND regexp_matches(text, '(?i)the')"""
)
def hit_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """What a check of power analyses does: sentences of a section with two patterns, and their paragraphs, each once."""
    text = talks(spark, d)
    hits = search_text(search_text(text, "ing", section="user"), "the")
    return expand_text(hits, text, "paragraph").select("id", "section", "div", "p", "expanded").distinct()


@query("SELECT CAST(doc_id AS VARCHAR) AS id, len(regexp_extract_all(text, '[0-9]+')) AS matches FROM documents WHERE regexp_matches(text, '[0-9]')")
def stream_search(spark: SparkSession, d: str) -> DataFrame:
    """Counts of matches by document, kept up over a stream of the table's file, and read when all of it has arrived."""
    base, run = shared_dir(spark), uuid.uuid4().hex
    counts = stream_counts(text_stream(spark, f"{d}/documents.parque[t]", spark.read.parquet(f"{d}/documents.parquet").schema.simpleString()[7:-1].replace(":", " ")), "[0-9]+")
    out = f"{base}/stream-{run}"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    # Each batch has the counts that it changed; of each document the last one holds.
    job = counts.writeStream.outputMode("update").option("checkpointLocation", f"{base}/stream-state-{run}").trigger(availableNow=True).foreachBatch(store).start()
    job.awaitTermination()
    return spark.read.parquet(out).groupBy("id").agg(F.max_by("matches", "batch").alias("matches"))


def entry(spark: SparkSession, d: str = "/root/testdata/sf0.001") -> DataFrame:
    """Digits in documents, counted by document: a search, a count, and zeros for those without."""
    text = doc_lines(spark, d)
    corpus = Corpus.of(spark, info=text.select("id").distinct(), full_text=text)
    counts = builtin.counted(search_text(corpus, "[0-9]+", return_="match"), "numbers")
    return corpus.ids().join(counts, "id", "left").select("id", F.coalesce("numbers", F.lit(0)).alias("numbers"))


from . import catalogue_queries, paper_queries  # noqa: E402, F401 (they register their queries, which use the above)
