"""URL filters by link-graph propagation.

Rules name a host, all its subdomains with it, and the start of a path; the longest rule that fits a url decides. Where none
fits, the link graph does: hosts are nodes, and the links of all pages from one host to another, counted, its edges. Pages that rules
allow make their hosts trusted seeds, pages that rules block make them distrusted seeds, in proportion to such pages.
Personalised PageRank carries trust along links, and distrust against them: who links to blocked hosts is distrusted. A host
whose distrust is above LIMIT times its trust is blocked, the others are allowed, as are hosts that neither reaches.

A rank is the sum of what reaches a host over all numbers of links; each round carries on what the last one brought (a join with the
edges, which are a table bucketed by source, and a sum), and writes it to a table, as what comes after would else recompute it. What is
left to be carried after a round is ONWARD / (1 - ONWARD) times that round's at most. Rounds end when no verdict can change any more: no host
has been reached anew, and at each host that both kinds reach the difference of its ranks is more than all that is left, or what is left
is less than EQUAL of its ranks. Ranks that differ by less than EQUAL of each other count as equal, whatever the order of sums.

Host: after the first ://, up to /, ? or #, A-Z lower-cased. Path: from there up to ? or #.

Links are the attributes href and src of tags, each after white space or /, if they begin with a scheme and ://, or with //. A tag ends at the first > outside quotes;
one whose quotes aren't closed is none.

Cases: a null url, or one without ://, has an empty host and path; no rule fits it, and its verdict is that of the host "". Null
html has no links; relative links stay on their host and count for nothing, whatever address they carry along. Rows repeat as they do in pages.
Other columns are not read. Empty tables work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Share of a rank that goes on along links.
ONWARD = 0.85
LIMIT, EQUAL = 1, 1e-9
#: Rounds between two looks at what is left.
LOOK = 8

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The loop of a tag is possessive in Java, so that one of any length takes no stack; as its parts begin with characters of their own, it matches as without.
TAG = r"""<[A-Za-z](?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""
ATTRIBUTE = r"""[\s/][^\s"'<>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
LINK = r"""(?i)^[\s/](?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"'>]*)"""


def _host(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(raw) + 1, F.char_length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules) for the hosts that rules fit: those of the host and of each domain that it is part of, as far as rules have labels."""
    most = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    domains = F.expr(f"array_distinct(transform(sequence(1, {most}), i -> substring_index(host, '.', -i)))")
    each = hosts.select("host", F.explode(domains).alias("domain"))
    rules = rules.select(F.col("host").alias("domain"), F.struct(F.char_length(F.concat("host", "path")).alias("length"), F.concat("host", "path").alias("rule"), "path", "verdict").alias("rule"))
    return each.join(rules, "domain").groupBy("host").agg(F.collect_set("rule").alias("rules"))


def links(pages: DataFrame) -> DataFrame:
    """(source, target, n): links between different hosts. pages: host, html."""
    tags = pages.select(F.col("host").alias("source"), F.explode(F.regexp_extract_all("html", F.lit(TAG), 0)).alias("tag"))
    tags = tags.where((F.col("source") != "") & F.contains("tag", F.lit("//")))
    found = tags.select("source", F.explode(F.regexp_extract_all("tag", F.lit(ATTRIBUTE), 0)).alias("attribute"))
    found = found.select("source", F.regexp_extract("attribute", LINK, 1).alias("link"))
    found = found.withColumn("link", F.when(F.col("link").startswith("//"), F.concat(F.lit(":"), "link")).otherwise(F.col("link")))
    found = found.select("source", _host(F.col("link"))[0].alias("target")).where((F.col("target") != "") & (F.col("target") != F.col("source")))
    return found.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def _both(ranks: DataFrame) -> DataFrame:
    """(host, trust, distrust), null where nothing of a kind has come."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")))
    return ranks.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))


def _blocked() -> Column:
    """More distrust than trust, or distrust alone, however little."""
    return F.coalesce(F.col("distrust") > LIMIT * (1 + EQUAL) * F.col("trust"), F.col("distrust").isNotNull())


def _open(ranks: DataFrame, left: dict[str, float]) -> bool:
    """Whether a verdict of a host that both kinds reach can change by what is left of each."""
    limit = F.col("trust") * LIMIT * (1 + EQUAL)
    more = F.lit(left.get("allow", 0.0)) * LIMIT * (1 + EQUAL)
    settled = F.when(F.col("distrust") > limit, F.col("distrust") > limit + more).otherwise(F.col("distrust") + left.get("block", 0.0) <= limit)
    near = F.lit(sum(left.values())) <= EQUAL * F.least("trust", "distrust")
    return not _both(ranks).where("trust IS NOT NULL AND distrust IS NOT NULL").where(~settled & ~near).isEmpty()


def propagate(seeds: DataFrame, edges: DataFrame, within: float = 1.0) -> DataFrame:
    """(kind, host, rank) after personalised PageRank, for each kind on its own, as far as comparisons of the kinds allow and block need it.

    seeds: kind, host, seed (1 in all of a kind); edges: kind, source, target, n. within: what may be left of a kind in any case.
    """
    totals = edges.groupBy("kind", "source").agg(F.sum("n").alias("total"))
    shares = edges.join(totals, ["kind", "source"]).select("kind", "source", "target", (ONWARD * F.col("n") / F.col("total")).alias("share"))
    with common.bucketed(shares, "edges", ["kind", "source"]) as edges:
        carried = common.as_table(seeds.select("kind", "host", ((1 - ONWARD) * F.col("seed")).alias("rank")), "ranks")
        ranks, hosts = carried, carried.count()
        while hosts and not edges.isEmpty():
            rounds = [ranks]
            for _ in range(LOOK):
                sent = carried.withColumnRenamed("host", "source").join(edges, ["kind", "source"])
                carried = common.as_table(sent.groupBy("kind", F.col("target").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("rank")), "ranks")
                rounds.append(carried)
            for more in rounds[1:]:
                rounds[0] = rounds[0].unionByName(more)
            ranks = common.as_table(rounds[0].groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "ranks")
            left = {r.kind: r.left for r in carried.groupBy("kind").agg((F.sum("rank") * ONWARD / (1 - ONWARD)).alias("left")).collect()}
            before, hosts = hosts, ranks.count()
            # A round without new hosts is the last one that could have had any.
            if not left or (hosts == before and max(left.values()) <= within and not _open(ranks, left)):
                break
    return ranks


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages(page_id, url, html). rules: verdict (allow, block), host, path."""
    host, path = _host(F.col("url").cast("string"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    # As tables, what there is for hosts has a known size: joined by broadcast if it is small, without dealing pages by host.
    fitting = common.as_table(fitting_rules(pages.select("host").distinct(), rules), "fitting-rules")
    ruled = pages.select("page_id", "host", "path").join(fitting, "host", "left")
    fit = F.filter("rules", lambda r: F.col("path").startswith(r["path"]))
    ruled = common.as_table(ruled.withColumn("best", F.array_max(fit)).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")), "ruled")
    counts = ruled.where(F.col("verdict").isNotNull()).groupBy(F.col("verdict").alias("kind"), "host").agg(F.count(F.lit(1)).alias("n"))
    counts = common.as_table(counts, "ruled-hosts")
    totals = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = counts.join(totals, "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("seed"))
    forward = common.as_table(links(pages), "links")
    edges = forward.select(F.lit("allow").alias("kind"), "source", "target", "n").unionByName(forward.select(F.lit("block").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "n"))
    blocked = _both(propagate(seeds, edges)).where(_blocked()).select("host", F.lit("block").alias("of_host"))
    out = ruled.join(common.as_table(blocked, "blocked-hosts"), "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "of_host", F.lit("allow")).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(common.read(spark, sf_dir, "pages"), rules)


def _sql() -> str:
    def host(url: str) -> str:
        return f"translate(regexp_extract(CASE WHEN contains({url}, '://') THEN substr({url}, instr({url}, '://') + 3) ELSE '' END, '^[^/?#]*'), '{UPPER}', '{LOWER}')"

    rest = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    tag, attribute, link = (x.replace("*+", "*").replace("++", "+").replace("'", "''") for x in (TAG, ATTRIBUTE, LINK))
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    # Ranks are carried on until they are nothing beside any other, so verdicts are those of the limit.
    return f"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {rules}),
p AS (
  SELECT row_number() OVER () AS r, page_id, coalesce({host("url")}, '') AS host,
         coalesce(regexp_extract(regexp_replace({rest}, '^[^/?#]*', ''), '^[^?#]*'), '') AS path, html
  FROM pages),
best AS (
  SELECT r, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule, arg_max(verdict, length(rules.host || rules.path)) AS verdict
  FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path)
  GROUP BY r),
ruled AS (SELECT p.r, page_id, host, path, rule, verdict FROM p LEFT JOIN best USING (r)),
counts AS (SELECT verdict AS kind, host, count(*) AS n FROM ruled WHERE verdict IS NOT NULL GROUP BY ALL),
home AS (SELECT kind, host, {1 - ONWARD} * n / sum(n) OVER (PARTITION BY kind) AS rank FROM counts),
tags AS (SELECT host AS source, unnest(regexp_extract_all(html, '{tag}')) AS tag FROM p),
attributes AS (SELECT source, unnest(regexp_extract_all(tag, '{attribute}')) AS attribute FROM tags),
found AS (SELECT source, regexp_extract(attribute, '{link}', 1) AS link FROM attributes),
named AS (SELECT source, {host("(CASE WHEN starts_with(link, '//') THEN ':' || link ELSE link END)")} AS target FROM found),
links AS (SELECT source, target, count(*) AS n FROM named WHERE source <> '' AND target <> '' AND source <> target GROUP BY ALL),
both_ways AS (SELECT 'allow' AS kind, source, target, n FROM links UNION ALL SELECT 'block', target, source, n FROM links),
edges AS (SELECT *, {ONWARD} * n / sum(n) OVER (PARTITION BY kind, source) AS share FROM both_ways),
rounds AS (
  SELECT kind, host, rank::DOUBLE AS rank FROM home
  UNION ALL
  SELECT r.kind, target, sum(rank * share)::DOUBLE
  FROM rounds r JOIN edges ON r.kind = edges.kind AND r.host = edges.source
  WHERE rank > 1e-300
  GROUP BY r.kind, target),
ranks AS (SELECT kind, host, sum(rank) AS rank FROM rounds GROUP BY kind, host),
hosts AS (
  SELECT host, coalesce(sum(rank) FILTER (WHERE kind = 'block') > {LIMIT * (1 + EQUAL)} * sum(rank) FILTER (WHERE kind = 'allow'), bool_or(kind = 'block')) AS blocked
  FROM ranks GROUP BY host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN hosts USING (host)
"""


SQL = _sql()
