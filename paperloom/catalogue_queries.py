"""Queries of what lies around papers: bibliographies, trees of projects and files, databases, reports, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bibliography, features, trees
from .plans.builtin import miscited, quotes
from .plans.report import write_reports
from .queries import REPORTED, _flagged, query, read, reported
from .schemas import Corpus
from .sources.databases import compact_retractions, difference, latest
from .streaming.files import shared_dir

# ---------------------------------------------------------------- titles looked up

PHRASE = "'The ' || lower(o_orderstatus) || ' effect of ' || o_custkey || ' in study ' || o_orderkey || ' again'"


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A bibliography with a work for each order, and each work's title as papers may cite it."""
    orders = read(spark, d, "orders").withColumn("title", F.expr(PHRASE))
    way = F.col("o_orderkey") % 5
    cited = F.when(way == 2, F.replace("title", F.lit(" effect"), F.lit(" efect"))).when(way == 3, F.concat("title", F.lit(": with many more words than that"))).when(way == 4, F.lit("Of something else")).otherwise(F.upper("title"))
    asked = orders.select(F.col("o_orderkey").alias("n"), cited.alias("title"), F.when(way == 1, "elsewhere").otherwise(F.col("o_orderpriority")).alias("source"))
    return asked, orders.select(F.col("o_orderkey").alias("work"), "title", F.col("o_orderpriority").alias("source"))


@query("SELECT o_orderkey AS n, CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey END AS work, CASE o_orderkey % 5 WHEN 1 THEN 'title' WHEN 2 THEN 'near' WHEN 4 THEN NULL ELSE 'both' END AS match FROM orders")
def titles_looked_up(spark: SparkSession, d: str) -> DataFrame:
    """Titles in capitals, from another journal, with a letter lost, with a subtitle, and of no work."""
    return bibliography.look_up(*_asked(spark, d), strict=False)


@query("SELECT o_orderkey AS n, CASE WHEN o_orderkey % 5 IN (0, 3) THEN '10.7/' || o_orderkey END AS doi FROM orders")
def dois_looked_up(spark: SparkSession, d: str) -> DataFrame:
    """The DOIs of references that have title and journal of one work."""
    asked, works = _asked(spark, d)
    bib = asked.select("n", "title", F.col("source").alias("journal"), F.lit("").alias("doi"))
    return bibliography.add_dois(bib, works.select(F.concat(F.lit("10.7/"), F.col("work").cast("string")).alias("doi"), "title", "source")).select("n", "doi")


# ---------------------------------------------------------------- trees


def _parents(key: Column) -> Column:
    """Each part's folder: its number without the last digit; single digits are at the top."""
    return F.when(key >= 10, F.expr("p_partkey div 10"))


TREE = """RECURSIVE node AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS parent, p_size FROM part),
tree AS (
  SELECT id, id AS root, NULL::BIGINT AS parent, 0 AS depth, [id] AS path FROM (SELECT id FROM node WHERE parent IS NULL UNION SELECT parent FROM node WHERE parent NOT IN (SELECT id FROM node))
  UNION ALL
  SELECT node.id, root, node.parent, depth + 1, list_append(path, node.id) FROM tree JOIN node ON node.parent = tree.id)"""


def _tree(spark: SparkSession, d: str) -> DataFrame:
    edges = read(spark, d, "part").select(F.col("p_partkey").alias("id"), _parents(F.col("p_partkey")).alias("parent"))
    tops = edges.where("parent IS NULL").select("id").unionByName(edges.select(F.col("parent").alias("id")).join(edges.select("id"), "id", "left_anti"))
    return trees.descendants(edges, tops)


@query(f"WITH {TREE} SELECT id, root, parent, depth, array_to_string(path, '/') AS path FROM tree")
def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    """Depth and path of every part in a tree of all."""
    return _tree(spark, d).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


@query(f"WITH {TREE}, each AS (SELECT root, unnest(path) AS above, id FROM tree) SELECT root, above AS id, count(*) AS n, sum(p_size)::BIGINT AS total FROM each LEFT JOIN node USING (id) GROUP BY root, above")
def tree_totals(spark: SparkSession, d: str) -> DataFrame:
    """How much lies in every folder and below."""
    return trees.totals(_tree(spark, d), read(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size"), "p_size")


# ---------------------------------------------------------------- databases that change

SNAPSHOTS = """old AS (SELECT CAST(o_custkey AS VARCHAR) AS doi, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS retractionwatch FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_custkey),
new AS (SELECT CAST(o_custkey AS VARCHAR) AS doi, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS retractionwatch FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey)"""


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The list of retractions at two times: orders are notices, of which some were withdrawn and others came."""
    notices = read(spark, d, "orders").select("o_orderstatus", F.col("o_custkey").cast("string").alias("OriginalPaperDOI"), F.col("o_orderpriority").alias("RetractionNature"))
    return compact_retractions(notices.where("o_orderstatus <> 'O'")), compact_retractions(notices.where("o_orderstatus <> 'F'"))


@query(
    f"""WITH {SNAPSHOTS} SELECT doi, CASE WHEN old.doi IS NULL THEN 'added' WHEN new.doi IS NULL THEN 'removed' ELSE 'changed' END AS change, old.retractionwatch AS before, new.retractionwatch AS after
FROM old FULL JOIN new USING (doi) WHERE old.retractionwatch IS DISTINCT FROM new.retractionwatch"""
)
def retraction_changes(spark: SparkSession, d: str) -> DataFrame:
    """What a newer list of retractions has otherwise."""
    return difference(*_snapshots(spark, d)).select("doi", "change", F.col("before.retractionwatch").alias("before"), F.col("after.retractionwatch").alias("after"))


@query(f"WITH {SNAPSHOTS} SELECT doi, coalesce(new.retractionwatch, old.retractionwatch) AS retractionwatch, CASE WHEN new.doi IS NULL THEN DATE '2024-01-31' ELSE DATE '2024-03-01' END AS date FROM old FULL JOIN new USING (doi)")
def retraction_latest(spark: SparkSession, d: str) -> DataFrame:
    """Two lists in one, the newer one's rows first."""
    old, new = _snapshots(spark, d)
    dated = lambda df, day: df.withColumn("date", F.lit(day).cast("date"))
    return latest(dated(old, "2024-01-31").unionByName(dated(new, "2024-03-01")))


# ---------------------------------------------------------------- reports


@query(
    """WITH bib AS (SELECT CAST(o_orderkey % 50 AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS xref_id, '10.1/' || o_custkey AS doi FROM orders),
xrefs AS (SELECT CAST(l_orderkey % 50 AS VARCHAR) AS id, CAST(l_orderkey AS VARCHAR) AS xref_id, 'Says ' || l_returnflag || l_suppkey AS text, l_linenumber AS s FROM lineitem),
db AS (SELECT '10.1/' || c_custkey AS doi, c_name AS reftext FROM customer WHERE c_acctbal < 0),
rows AS (SELECT DISTINCT id, xref_id, doi, reftext, text, s FROM bib JOIN db USING (doi) LEFT JOIN xrefs USING (id, xref_id)),
n AS (SELECT doi, reftext, count(text) AS n FROM rows GROUP BY ALL), t AS (SELECT DISTINCT doi, reftext, text FROM rows WHERE text IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY text) AS place FROM t)
SELECT n.doi, n.reftext, n.n, p.text, p.place FROM n LEFT JOIN (SELECT * FROM p WHERE place <= 5) p USING (doi)"""
)
def miscitation_quotes(spark: SparkSession, d: str) -> DataFrame:
    """The first sentences that cite each paper that is often miscited, as a report shows them."""
    corpus, _ = _flagged(spark, d)
    cited = read(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 50).cast("string").alias("id"), F.col("l_orderkey").cast("string").alias("xref_id"), F.concat(F.lit("Says "), "l_returnflag", F.col("l_suppkey").cast("string")).alias("text"),
        F.lit("intro").alias("section"), F.lit(1).alias("div"), F.lit(1).alias("p"), F.col("l_linenumber").alias("s"),
    )
    db = read(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("10.1/"), F.col("c_custkey").cast("string")).alias("doi"), F.col("c_name").alias("reftext"), F.lit("look").alias("warning"))
    return quotes(miscited(Corpus.of(spark, info=corpus.info, bib=corpus.bib, xrefs=cited), db)).select("doi", "reftext", "n", "text", "place")


_LINES = "chr(10) || chr(10)"


@query(
    f"""WITH {REPORTED}, seqs AS (SELECT id, div, p, s, text, s::BIGINT * 10 + div AS seq FROM reported),
ids AS (SELECT DISTINCT id FROM seqs),
m AS (SELECT *, unnest(CASE WHEN starts_with(text, 'A t(') THEN [regexp_extract(text, 'p < \\.[0-9]+')] WHEN starts_with(text, 'An F(') THEN [regexp_extract(text, 'p = \\.[0-9]+'), 'p>.3'] WHEN starts_with(text, 'With t') THEN ['p = n.s.'] ELSE [] END) AS found FROM seqs),
i AS (SELECT id, seq, '| ' || found || ' |  | ' || div || ' | ' || p || ' | ' || s || ' |' AS line FROM m WHERE NOT starts_with(found, 'p = .') AND found <> 'p < .00'),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, line) AS place, count(*) OVER (PARTITION BY id) AS n FROM i),
t AS (SELECT id, 'Showing ' || count(*) || ' of ' || min(n) || ' rows' || {_LINES} || '| text | section | div | p | s |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY place) AS body FROM w WHERE place <= 5 GROUP BY id)
SELECT id || '_report.md' AS name, '# ' || id || {_LINES} || '## Exact P-Values' || {_LINES} || coalesce(body, 'Nothing found.') || {_LINES} || '## Marginal Significance' || {_LINES} || 'Nothing found.' || chr(10) AS report FROM ids LEFT JOIN t USING (id)"""
)
def reports_of_papers(spark: SparkSession, d: str) -> DataFrame:
    """Every paper's report, written to files by tasks and read back."""
    folder = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    write_reports(Corpus.of(spark, full_text=reported(spark, d)), folder, ("exact_p", "marginal"), max_rows=5).agg(F.sum("bytes")).collect()
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("report"))


# ---------------------------------------------------------------- words that tell


@query()
def words_classified(spark: SparkSession, d: str) -> DataFrame:
    """Documents judged by a regression on their words, fitted to those that are labelled; tests look at its gradient."""
    docs = read(spark, d, "documents")
    fitted = features.word_classifier(docs.join(read(spark, d, "labels"), "doc_id").select("text", F.col("toxic").alias("label")))
    return fitted.transform(docs.select("doc_id", "text")).select("doc_id", "prediction", F.round("probability", 6).alias("probability"))
