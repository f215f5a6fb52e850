"""The built-in modules. Their tables are lazy; a traffic light takes one small aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import settings
from ..functions.json_columns import few_values
from ..functions.text import squeeze
from ..operators.search import expand_text, full_text, search_text
from ..operators.statcheck import stats
from ..operators.tables import info_table
from ..schemas import Corpus, null_safe_join
from ..sources.stored import kept
from .modules import module

# ---------------------------------------------------------------- fixed values: patterns

OPERATORS = "=<>~≈≠≤≥≪≫"
P_VALUE = rf"\bp-?(value)?\s*[{OPERATORS}]{{1,2}}\s*(n\.?s\.?|\d?\.\d+)(\s*e\s*-\d+)?(\s*[x*]\s*10\s*\^\s*-\d+)?"
NUMBER = r"[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?"
T_TEST = rf"\bt\s*(\(\s*\d+(\.\d+)?\s*\))?\s*=\s*{NUMBER}"
F_TEST = rf"\bF\s*\(\s*\d+\s*,\s*\d+\s*\)\s*=\s*{NUMBER}"
COMPARES = rf"\s*[=≈<>≤≥]{{1,3}}\s*{NUMBER}"
T_EFFECTS = rf"\b(cohen['’]?s\s+d|cohen['’]?s\s+d\s*z|d|d\s*z|ds|hedges?['’]?s?\s+g|g|b|r|β)\b{COMPARES}"
F_EFFECTS = rf"\b(cohen['’]?s\s+f|f\s*[2²]?|η\s*p*\s*[2²]|partial\s+η\s*[2²]|omega\s*[2²]?|ω\s*[2²]?|cohen['’]?s\s+d|d|β|η\s*G\s*[2²]|R\s*[2²]|R|r|ω\s*p\s*[2²]?|BF\s*\d*){COMPARES}"
MARGINAL = (
    r"margin\w* (?:\w+\s+){0,5}significan\w*"
    r"|trend\w* (?:\w+\s+){0,1}significan\w*"
    r"|almost (?:\w+\s+){0,2}significan\w*"
    r"|approach\w* (?:\w+\s+){0,2}significan\w*"
    r"|border\w* (?:\w+\s+){0,2}significan\w*"
    r"|close to (?:\w+\s+){0,2}significan\w*"
)
URL = (
    r"\b((?:doi:)?(?:https?://)?"
    r"(?:(?:www\.)?(?:[\da-z\.-]+)\.(?:[a-z]{2,6})"
    r"|(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
    r"|(?:(?:[0-9a-fA-F]{1,4}:){7,7}[0-9a-fA-F]{1,4}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,7}:"
    r"|(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,5}(?::[0-9a-fA-F]{1,4}){1,2}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,4}(?::[0-9a-fA-F]{1,4}){1,3}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,3}(?::[0-9a-fA-F]{1,4}){1,4}"
    r"|(?:[0-9a-fA-F]{1,4}:){1,2}(?::[0-9a-fA-F]{1,4}){1,5}"
    r"|[0-9a-fA-F]{1,4}:(?:(?::[0-9a-fA-F]{1,4}){1,6})"
    r"|:(?:(?::[0-9a-fA-F]{1,4}){1,7}|:)"
    r"|fe80:(?::[0-9a-fA-F]{0,4}){0,4}%[0-9a-zA-Z]{1,}"
    r"|::(?:ffff(?::0{1,4}){0,1}:){0,1}(?:(?:25[0-5]|(?:2[0-4]|1{0,1}[0-9]){0,1}[0-9])\.){3,3}(?:25[0-5]|(?:2[0-4]|1{0,1}[0-9]){0,1}[0-9])"
    r"|(?:[0-9a-fA-F]{1,4}:){1,4}:(?:(?:25[0-5]|(?:2[0-4]|1{0,1}[0-9]){0,1}[0-9])\.){3,3}(?:25[0-5]|(?:2[0-4]|1{0,1}[0-9]){0,1}[0-9])))"
    r"(?::[0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])?"
    r"(?:/[\w\.-]*)*/?)\b"
)


def counted(table: DataFrame, name: str) -> DataFrame:
    return table.groupBy("id").agg(F.count(F.lit(1)).alias(name))


def found(table: DataFrame, yes: str, no: str) -> str:
    return no if table.isEmpty() else yes


# ---------------------------------------------------------------- p values and effect sizes


def p_values(source: Corpus | DataFrame) -> DataFrame:
    """Each p value in the text, with its comparison and, unless it is n.s., its number."""
    p = search_text(source, P_VALUE, return_="match", ignore_case=False)
    value = F.regexp_replace(F.regexp_extract("text", rf"[{OPERATORS}]{{1,2}}\s*([^{OPERATORS}]*)$", 1), r"\s", "")
    return p.withColumn("p_comp", F.regexp_extract("text", rf"[{OPERATORS}]{{1,2}}", 0)).withColumn("p_value", F.regexp_replace(value, r"[x*]10\^", "e").try_cast("double"))


def with_imprecise(p: DataFrame) -> DataFrame:
    """Imprecise: an upper bound above .001, another comparison than = or <, or no number."""
    return p.withColumn("imprecise", F.coalesce((F.col("p_comp") == "<") & (F.col("p_value") > 0.001), F.lit(False)) | ~F.col("p_comp").isin("=", "<") | F.col("p_value").isNull())


@module("List All P-Values", "A table of every p value that is reported, such as 'p = 0.04', and of where it stands.")
def all_p_values(corpus: Corpus) -> dict:
    table = p_values(corpus)
    return {"table": table, "summary": counted(table, "p_values"), "na_replace": 0}


@module("Exact P-Values", "Find p values that are only bounded or left out, such as p < .05 or n.s.")
def exact_p(corpus: Corpus) -> dict:
    p = kept(with_imprecise(p_values(corpus)))  # only what was found; table, summary and light all need it
    summary = p.groupBy("id").agg(F.count_if(~F.col("imprecise")).alias("exact_p"), F.count_if("imprecise").alias("imprecise_p"))
    total = summary.agg(F.sum("exact_p").alias("exact"), F.sum("imprecise_p").alias("imprecise")).first()
    light = "na" if total.exact is None else "red" if total.imprecise else "green"
    report = {"red": "There are p values that could be given more exactly.", "green": "Every p value is given exactly.", "na": "There are no p values."}
    columns = ["text", "p_comp", "p_value", "section", "header", "div", "p", "s", "id", "seq"]
    return {"table": p.where("imprecise").select(columns), "summary": summary, "na_replace": 0, "traffic_light": light, "report": report[light]}


def effect_tests(source: Corpus | DataFrame) -> DataFrame:
    """t and F tests with the effect sizes reported beside them (null if none), in one pass without a shuffle: each sentence counts, whether or not an equal one stands in its place."""
    joined = lambda pattern: F.array_join(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), "; ")
    text = full_text(source)
    likely = text.where(F.col("text").contains("=") & F.col("text").rlike("[0-9]"))  # the cheap test first
    tested = likely.withColumn("text", squeeze(F.col("text"))).where(F.col("text").rlike(T_TEST) | F.col("text").rlike(F_TEST))
    sentences = tested.select("id", "text", "section", "div", "p", "s", "seq")
    kinds = (("t-test", T_TEST, T_EFFECTS), ("F-test", F_TEST, F_EFFECTS))
    found = [F.when(F.col("text").rlike(test), F.struct(F.nullif(joined(f"(?iu){effect}"), F.lit("")).alias("es"), joined(test).alias("test_text"), F.lit(name).alias("test"))) for name, test, effect in kinds]
    return sentences.withColumn("_x", F.explode(F.array_compact(F.array(*found)))).select(*sentences.columns, "_x.*")


def effect_summary(table: DataFrame) -> DataFrame:
    kinds = [(f"{t}tests_{w}_es", (F.col("test") == f"{t}-test") & (F.col("es").isNotNull() if w == "with" else F.col("es").isNull())) for t in "tF" for w in ("with", "without")]
    return table.groupBy("id").agg(*(F.count_if(c).alias(n) for n, c in kinds))


@module("Missing Effect Sizes", "Find t tests and F tests without an effect size beside them")
def effect_size(corpus: Corpus) -> dict:
    table = kept(effect_tests(corpus))
    n, without = table.agg(F.count(F.lit(1)), F.count_if(F.col("es").isNull())).first()
    light = "na" if not n else "green" if not without else "red" if without == n else "yellow"
    report = {
        "na": "There are no t tests or F tests.",
        "red": "None of the t tests and F tests comes with an effect size; reporting guidelines want one for each.",
        "yellow": "Only a part of the t tests and F tests comes with an effect size; reporting guidelines want one for each.",
        "green": "Each t test and F test comes with an effect size in its sentence.",
    }
    return {"table": table, "summary": effect_summary(table), "na_replace": 0, "traffic_light": light, "report": report[light]}


@module("StatCheck", "Recompute p values from the reported statistics and compare")
def statcheck(corpus: Corpus) -> dict:
    table = kept(stats(corpus))
    summary = table.groupBy("id").agg(F.count(F.lit(1)).alias("stats_found"), F.count_if("error").alias("stats_error"), F.count_if("decision_error").alias("decision_error"))
    n, errors = table.agg(F.count(F.lit(1)), F.count_if("error")).first()
    light = "na" if not n else "red" if errors else "green"
    report = {"na": "There are no test statistics", "red": "Some reported p values don't follow from their statistics", "green": "Every reported p value follows from its statistic"}
    return {"table": table.where("error"), "summary": summary, "na_replace": 0, "traffic_light": light, "report": report[light]}


# ---------------------------------------------------------------- phrases and links


@module("Marginal Significance", "Find sentences that call an effect nearly significant.")
def marginal(corpus: Corpus) -> dict:
    table = search_text(corpus, MARGINAL)
    light = found(table, "red", "green")
    report = {
        "red": "Some effects are called nearly significant. A result is significant at the chosen level or it isn't: say which, and give the p value.",
        "green": "No effect is called nearly significant.",
    }
    return {"table": table, "summary": counted(table, "marginal"), "na_replace": 0, "traffic_light": light, "report": report[light]}


@module("List All URLs", "A table of the web addresses in the text.")
def all_urls(corpus: Corpus) -> dict:
    table = search_text(corpus, URL, return_="match")
    return {"table": table, "summary": counted(table, "urls"), "na_replace": 0}


@module("Power", "Find power analyses and take them apart.")
def power(corpus: Corpus, seed: int = 8675309, client=None) -> dict:
    from ..sources.chat_model import POWER_FIELDS, POWER_QUERY, ask
    from ..functions.json_columns import json_expand

    hits = search_text(search_text(corpus, "power", section="method"), "[0-9]")
    table = expand_text(hits, corpus, "paragraph").select("id", "section", "div", "p", "expanded").distinct()
    used = settings.chat_use or client is not None
    empty = table.isEmpty()
    if used and not empty:
        answers = json_expand(ask(table, POWER_QUERY, text_col="expanded", seed=seed, client=client), fields=list(POWER_FIELDS))
        split = answers.withColumn("_x", F.explode(F.arrays_zip(*(F.split(F.coalesce(c, F.lit("")), "; ").alias(c) for c in POWER_FIELDS)))).drop(*POWER_FIELDS)
        value = lambda c: F.nullif(F.nullif(F.col(f"_x.{c}"), F.lit("")), F.lit("NA"))
        table = split.withColumns({c: value(c) for c in POWER_FIELDS}).drop("_x")
        complete = F.lit(True)
        for c in POWER_FIELDS:
            complete = complete & F.col(c).isNotNull()
        table = kept(table.withColumn("complete", complete).where("type IS NULL OR type <> 'none'"))
        summary = table.groupBy("id").agg(
            F.count(F.lit(1)).alias("power.n"), F.count_if("complete").alias("power.complete"), *(F.count(c).alias(f"power.{c}") for c in POWER_FIELDS)
        )
        rows = table.agg(F.count(F.lit(1)), F.count_if("complete")).first()
        light = "na" if not rows[0] else "green" if rows[0] == rows[1] else "red"
    else:
        summary = table.groupBy("id").agg(F.count(F.lit(1)).alias("power.n"), F.lit(None).cast("bigint").alias("power.complete"))
        light = "na" if empty else "yellow"
    report = {
        "na": "There are no power analyses.",
        "red": "There are power analyses, but parts of them seem to be missing.",
        "yellow": "There are power analyses. No language model was asked whether they are complete; read them.",
        "green": "There are power analyses, and nothing seems to be missing.",
    }
    needs = "To be understood, a power analysis has to give its test, sample size, alpha, power, and the effect size with its unit."
    return {"table": table, "summary": summary, "na_replace": {"power.n": 0}, "traffic_light": light, "report": f"{needs}\n\n{report[light]}"}


# ---------------------------------------------------------------- references


def flagged_references(corpus: Corpus, db: DataFrame, normalize: bool = False) -> DataFrame:
    """References whose doi is in a database, with every place that cites them. normalize: compare DOIs in small letters."""
    key = (lambda c: F.lower(F.trim(c))) if normalize else (lambda c: c)
    db = db.select(key(F.col("doi")).alias("_doi"), *(c for c in db.columns if c != "doi"))
    hits = corpus.bib.join(db, key(F.col("doi")) == F.col("_doi")).drop("_doi")
    cites = corpus.xrefs.select("id", "xref_id", "type", "contents", "text", "section", "div", "p", "s")
    return null_safe_join(hits, cites, ["id", "xref_id"], "left")


def pivot_counts(table: DataFrame, column: str, prefix: str) -> DataFrame:
    """Counts of a column's values for each id. The values are few: kinds of entries; too many are an error."""
    values = few_values(table, column)
    if not values:
        return table.groupBy("id").agg(F.lit(0).alias(f"{prefix}none")).select("id")
    return table.groupBy("id").agg(*(F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values))


@module("RetractionWatch", "Mark cited papers that the list of retractions has")
def retractionwatch(corpus: Corpus, db: DataFrame | None = None, date: str | None = None) -> dict:
    from ..sources.databases import retraction_date, retractions

    spark = corpus.info.sparkSession
    date = date or (retraction_date(spark) if db is None else None)
    table = flagged_references(corpus, retractions(spark) if db is None else db)
    light = found(table, "yellow", "green")
    known = f" (as of {date})" if date else ""
    report = {
        "yellow": f"The list of retractions{known} has some of the cited papers: look whether they were retracted, corrected or questioned.",
        "green": f"The list of retractions{known} has none of the cited papers.",
    }
    return {"table": table, "summary": pivot_counts(table, "retractionwatch", "rw_"), "na_replace": 0, "traffic_light": light, "report": report[light]}


def unmatched_references(bib: DataFrame, xrefs: DataFrame) -> DataFrame:
    """References that are not cited (missing xrefs), and citations without reference (missing bib)."""
    keys = ["id", "xref_id"]
    uncited = null_safe_join(bib, xrefs.select(*keys).distinct(), keys, "left_anti").withColumn("missing", F.lit("xrefs"))
    unlisted = null_safe_join(xrefs, bib.select(*keys).distinct(), keys, "left_anti").withColumnRenamed("text", "ref").withColumn("missing", F.lit("bib"))
    return uncited.unionByName(unlisted, allowMissingColumns=True)


def reference_counts(ids: DataFrame, bib: DataFrame, xrefs: DataFrame, table: DataFrame) -> DataFrame:
    missing = table.groupBy("id").agg(*(F.count_if(F.col("missing") == m).alias(f"missing_{m}") for m in ("bib", "xrefs")))
    return ids.join(counted(bib, "n_bib"), "id", "left").join(counted(xrefs, "n_xrefs"), "id", "left").join(missing, "id", "left")


@module("Reference Consistency", "Match the citations in the text with the list of references")
def ref_consistency(corpus: Corpus) -> dict:
    table = unmatched_references(corpus.bib, corpus.xrefs)
    summary = reference_counts(info_table(corpus, []), corpus.bib, corpus.xrefs, table)
    light = "na" if corpus.bib.isEmpty() else "green" if table.isEmpty() else "red"
    report = {
        "red": "Some citations have no entry in the list of references, or some entries are never cited.",
        "green": "Citations and list of references agree.",
        "na": "There is no list of references.",
    }
    note = "This rests on how the file was converted, so look at each case."
    return {"table": table.orderBy("id", "xref_id"), "summary": summary, "na_replace": 0, "traffic_light": light, "report": f"{note}\n\n{report[light]}"}


def miscited(corpus: Corpus, db: DataFrame) -> DataFrame:
    """References in the database with the sentences that cite them; those never cited have none."""
    hits = corpus.bib.select("xref_id", "ref", "doi", "id").join(db.select("doi", "reftext", "warning"), "doi").distinct()
    cites = corpus.xrefs.select("id", "xref_id", "text", "section", "div", "p", "s")
    return null_safe_join(hits, cites, ["id", "xref_id"], "left").distinct()


#: Citing sentences that a report shows of each paper.
QUOTES = 5


def quotes(rows: DataFrame, most: int = QUOTES) -> DataFrame:
    """(doi, reftext, warning, n, text, place) of miscited(): how often each paper is cited, and the first sentences that do, in the order of the alphabet.

    Spark limits the groups before it shuffles them for the window, so a paper that everyone cites is no more than most rows a task. Papers that
    no sentence cites have one row without text.
    """
    keys = ["doi", "reftext", "warning"]
    counts = rows.groupBy(*keys).agg(F.count("text").alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("text"))
    first = rows.where("text IS NOT NULL").select(*keys, "text").distinct().withColumn("place", place).where(F.col("place") <= most)
    return null_safe_join(counts, first, keys, "left").select(*keys, "n", "text", "place")


@module("Miscitation", "Find papers that are often cited for what they don't say.", "The database needs the columns doi (short, like 10.1/x), reftext and warning.")
def miscitation(corpus: Corpus, db: DataFrame | None = None) -> dict:
    from ..sources.databases import miscitations

    rows = miscited(corpus, miscitations(corpus.info.sparkSession) if db is None else db)
    table = rows.select("id", "xref_id", "doi", "text", "section", "div", "p", "s").distinct()
    dois = few_values(rows, "doi")
    summary = table.groupBy("id").agg(*(F.min(F.when(F.col("doi") == d, F.col("xref_id"))).alias(f"miscite_{d}") for d in dois)) if dois else table.select("id").distinct()
    if not dois:
        return {"table": table, "summary": summary, "traffic_light": "green", "report": "None of these papers is cited."}
    parts = ["These papers are often cited for what they don't say."]
    shown = quotes(rows)
    for r in shown.groupBy("doi", "reftext", "warning").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("text")).alias("quotes")).orderBy("doi").collect():
        count = f"{len(r.quotes)} of {r.n}" if len(r.quotes) < r.n else str(r.n)
        parts += [f"**{r.doi}**", r.reftext or "", r.warning or "", f"*{count} instance{'' if r.n == 1 else 's'}:*", *(f"> {q}" for q in r.quotes)]
    return {"table": table, "summary": summary, "traffic_light": "yellow", "report": "\n\n".join(parts)}


# ---------------------------------------------------------------- registries of studies


def osf_status(table: DataFrame) -> DataFrame:
    """status of each retrieved link."""
    kind, public = F.col("osf_type"), F.col("public")
    status = (
        F.when(F.col("osf_id").isNull(), "invalid")
        .when(kind.isin("too many requests", "unfound"), kind)
        .when((kind == "private") | ~public, "closed")
        .when(public | kind.isNotNull(), "open")
        .otherwise("")
    )
    return table.withColumn("status", status)


@module("Check Status of OSF Links", "A table of links to OSF, and whether each can be opened.")
def osf_check(corpus: Corpus, client=None) -> dict:
    from ..sources.osf import osf_links, osf_retrieve

    links = osf_links(corpus)
    if links.isEmpty():
        return {"table": links, "summary": links.select("id").limit(0), "na_replace": 0, "traffic_light": "na", "report": "There are no links to OSF."}
    table = kept(osf_status(osf_retrieve(links, "text", client=client)))
    states = {r.status for r in table.select("status").distinct().collect()}
    light = "fail" if states in ({"error"}, {"unknown"}) else "red" if states & {"unfound", "invalid", "closed"} else "green" if states == {"open"} else "yellow"
    report = {"fail": "None of the links to OSF could be looked up.", "red": "Some links to OSF are private or lead nowhere.", "yellow": "Some links to OSF could not be looked up.", "green": "Every link to OSF can be opened."}
    return {"table": table, "summary": pivot_counts(table, "status", "osf."), "na_replace": 0, "traffic_light": light, "report": report[light]}


@module("AsPredicted", "Fetch the answers given in AsPredicted pre-registrations")
def aspredicted(corpus: Corpus, client=None) -> dict:
    from ..sources.preregistrations import aspredicted_links, aspredicted_retrieve

    links = aspredicted_links(corpus)
    if links.isEmpty():
        return {"table": links, "summary": links.select("id").limit(0), "na_replace": 0, "traffic_light": "na", "report": "There are no links to AsPredicted."}
    table = kept(aspredicted_retrieve(links, "text", client=client))
    summary = table.groupBy("id").agg(F.count_distinct("text").alias("AP_links"))
    n = summary.agg(F.sum("AP_links")).first()[0]
    report = f"{n} pre-registration{'' if n == 1 else 's'} on AsPredicted fetched."
    if corpus.ids().limit(2).count() == 1:
        sizes = [r[0] for r in table.select("AP_sample_size").distinct().orderBy("AP_sample_size").collect() if r[0]]  # of one paper
        report += "\n\nOf the sample size, from which studies stray most often, they say:\n\n" + "\n\n".join(f"> {s}" for s in sizes)
    return {"table": table, "summary": summary, "na_replace": 0, "traffic_light": "info", "report": report}


