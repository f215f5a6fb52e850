"""Reported tests, their p values computed anew, and whether the two agree.

Results such as "t(28) = 2.20, p = .036" are found, taken apart and judged with DataFrame functions. A p value agrees if some value
of the statistic that rounds to the reported one gives, rounded as reported, that p value (method of Nuijten and others, 2016).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.text import squeeze
from ..schemas import Corpus
from ..sources.stored import stored
from .search import distinct_rows, full_text, search_text

# The form in which the tests are reported. Groups: test, degrees of freedom, comparison, value, p value.
_NUM = r"\d*\.?\d+"
_VALUE = r"[^a-zA-Z\d\.\s(,]{0,3}\s?\d*,?\d*\.?\d+"
_P = r"(?:p\s?[<>=]\s?\d?\.\d+(?:e-?\d+)?|[^a-zA-Z]n\.?s\.?)"
RESULT = (
    r"(?:(?<![A-Za-z])(t|r|Q\s?-?\s?(?:[wW]ithin|[bB]etween|[wWbB])?)\s?\(\s?" + _NUM + r"\s?\)"
    r"|(?<![A-Za-z])F\s?\(\s?\d*\.?(?:I|l|\d+)\s?,\s?" + _NUM + r"\s?\)"
    r"|(?:[χΧ𝜒]|\bchi|[xX](?=\s?(?:2|²|\^2)))\s?-?(?:2|²|\^2|squared?)?\s?\(\s?" + _NUM + r"(?:\s?,\s?[Nn]\s?=\s?[\d,]+)?\s?\)"
    r"|(?<=[^a-zA-Z])[zZ])\s?[<>=]\s?" + _VALUE + r"\s?,\s?" + _P
)
STATISTICS = ("t", "F", "cor", "chisq", "Z", "Q")
COLUMNS = ["raw", "test_type", "df1", "df2", "test_comp", "test_value", "p_comp", "reported_p", "computed_p", "error", "decision_error"]


def _number(x):
    return F.expr("1") if x is None else F.when(x == "", None).otherwise(x).try_cast("double")


def result_texts(text: DataFrame) -> DataFrame:
    """A row for each reported result, as it stands (raw); the columns of text stay. Of equal sentences in one place the first counts."""
    # Only sentences with a result are compared with each other, and so shuffled.
    rows = text.select("*", F.posexplode(F.regexp_extract_all(F.concat(F.lit(" "), "text"), F.lit(RESULT), F.lit(0))).alias("_at", "raw"))
    return distinct_rows(rows).drop("_at").withColumn("raw", F.trim("raw"))


def results(rows: DataFrame) -> DataFrame:
    """rows(raw) with the parts of results, without those that can't be."""
    raw = F.col("raw")
    kind = (
        F.when(raw.rlike(r"^t"), "t").when(raw.rlike("^F"), "F").when(raw.rlike("^r"), "cor").when(raw.rlike("^Q"), "Q").when(raw.rlike("^[zZ]"), "Z").otherwise("chisq")
    )
    inside = F.regexp_extract(raw, r"^[^(<>=]*\(([^)]*)\)", 1)
    first = F.regexp_replace(F.trim(F.substring_index(inside, ",", 1)), "[Il]$", "1")
    second = F.trim(F.regexp_extract(inside, r",\s*([^,]*)$", 1))
    # What stands after the degrees of freedom: comparison, value, p value.
    rest = F.regexp_replace(raw, r"^[^(<>=]*\([^)]*\)", "")
    comp = F.regexp_extract(rest, "([<>=])", 1)
    value = F.regexp_extract(rest, rf"[<>=]\s?({_VALUE})\s?,", 1)
    digits = F.replace(F.regexp_extract(value, r"(\d*,?\d*\.?\d+)$", 1), F.lit(","), F.lit(""))
    sign = F.when(F.regexp_replace(F.regexp_replace(value, r"[\d.,]+$", ""), r"\s", "") != "", -1).otherwise(1)
    p = F.regexp_extract(rest, rf",\s?({_P})$", 1)
    none = p.rlike(r"n\.?s")
    p_digits = F.regexp_extract(p, r"[<>=]\s?(.*)$", 1)
    decimals = lambda x: F.length(F.regexp_extract(x, r"\.(\d+)", 1))
    rows = rows.withColumns(
        {
            "test_type": kind,
            "df1": F.when(kind == "F", _number(first)).when(kind == "chisq", _number(first)).otherwise(None),
            "df2": F.when(kind == "F", _number(second)).when(kind.isin("t", "cor", "Q"), _number(first)).otherwise(None),
            "test_comp": comp,
            "test_value": digits.try_cast("double") * sign,
            "_decimals": decimals(digits),
            "p_comp": F.when(none, "ns").otherwise(F.regexp_extract(p, "([<>=])", 1)),
            "reported_p": F.when(none, None).otherwise(p_digits.try_cast("double")),
            "_p_decimals": decimals(p_digits) + F.coalesce(F.regexp_extract(p_digits, r"e-(\d+)", 1).try_cast("int"), F.lit(0)),
        }
    )
    possible = F.col("test_value").isNotNull() & (F.coalesce("reported_p", F.lit(0.0)) <= 1) & ~((F.col("test_type") == "cor") & (F.abs("test_value") > 1))
    return rows.where(possible)


def p_value(kind: Column, value: Column, df1: Column, df2: Column) -> Column:
    """The two-sided p value of t, r and z, the upper tail of the others."""
    return (
        F.when(kind == "t", tails.t_two_sided(value, df2))
        .when(kind == "cor", tails.r_two_sided(value, df2))
        .when(kind == "F", tails.f_upper(value, df1, df2))
        .when(kind == "chisq", tails.chi2_upper(value, df1))
        .when(kind == "Q", tails.chi2_upper(value, df2))
        .when(kind == "Z", tails.normal_two_sided(value))
    )


def judge(rows: DataFrame, alpha: float, one_tailed: bool, equal_is_significant: bool, zero_is_error: bool) -> DataFrame:
    """rows with computed_p, error and decision_error."""
    kind, value, reported, comp, test = (F.col(c) for c in ("test_type", "test_value", "reported_p", "p_comp", "test_comp"))
    share = F.when(kind.isin("t", "cor", "Z"), 0.5 if one_tailed else 1.0).otherwise(1.0)
    half = 0.5 * F.pow(F.lit(10.0), -F.col("_decimals"))
    outwards = F.when(value < 0, -half).otherwise(half)
    # The largest p is that of the value nearest to 0 that rounds as reported.
    near = F.when(F.abs(value) < half, 0.0).otherwise(value - outwards)
    far = F.when(kind == "cor", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value + outwards))).otherwise(value + outwards)
    found = F.transform(F.array(value, near, far), lambda v: p_value(kind, v, F.col("df1"), F.col("df2")) * share)
    rows = rows.withColumn("_p", found)
    computed, high, low = (F.col("_p")[k] for k in range(3))
    slack = 0.5 * F.pow(F.lit(10.0), -F.col("_p_decimals")) + 1e-12
    below, above = reported >= low - slack, reported <= high + slack
    # "t < 1, p > .1": the comparison of the statistic turns that of its p value around.
    agrees = (
        F.when(comp == "=", F.when(test == "=", below & above).when(test == "<", below).otherwise(above))
        .when(comp == "<", F.when(test == "<", computed < reported).otherwise(low < reported))
        .when(comp == ">", F.when(test == ">", computed > reported).otherwise(high > reported))
        .when(comp == "ns", high > alpha)
        .otherwise(True)
    )
    significant = (lambda p: p <= alpha) if equal_is_significant else (lambda p: p < alpha)
    says = F.when(comp == "=", significant(reported)).when(comp == "<", reported <= alpha).otherwise(False)
    error = ~F.coalesce(agrees, F.lit(False))
    if zero_is_error:
        error = error | ((comp != ">") & F.coalesce(reported == 0, F.lit(False)))
    error = error & computed.isNotNull()
    unclear = F.coalesce(((comp == "<") & (reported > alpha)) | ((comp == ">") & (reported < alpha)), F.lit(False))
    wrong = F.coalesce(says, F.lit(False)) != F.coalesce(significant(computed), F.lit(False))
    return rows.withColumns({"computed_p": computed, "error": error, "decision_error": error & ~unclear & wrong})


def stats(
    source: Corpus | DataFrame,
    stat: str | list[str] = STATISTICS,
    alpha: float = 0.05,
    one_tailed: bool = False,
    equal_is_significant: bool = True,
    zero_is_error: bool = True,
    all_p_values: bool = False,
) -> DataFrame:
    """A row for each reported test in the text, with COLUMNS and the text's own. all_p_values: instead, each p value with its comparison."""
    if all_p_values:
        text = search_text(source, "[0-9]")
        found = text.withColumn("raw", F.explode(F.regexp_extract_all("text", F.lit(_P), F.lit(0))))
        p = F.regexp_extract("raw", r"[<>=]\s?(.*)$", 1)
        return found.withColumn("p_comp", F.when(F.col("raw").rlike("[<>=]"), F.regexp_extract("raw", "([<>=])", 1)).otherwise("ns")).withColumn("reported_p", F.when(p == "", None).otherwise(p).try_cast("double"))
    # The cheap test first: a result has a comma and a comparison.
    text = full_text(source).where(F.col("text").contains(",") & F.col("text").rlike("[<>=]") & F.col("text").rlike("[0-9]"))
    text = text.withColumn("text", squeeze(F.col("text")))
    wanted = [stat] if isinstance(stat, str) else list(stat)
    # A result is taken apart and judged once, wherever it is reported.
    rows = stored(result_texts(text), "results")
    each = results(rows.select("raw").distinct()).where(F.col("test_type").isin(wanted))
    each = stored(judge(each, alpha, one_tailed, equal_is_significant, zero_is_error).select(*COLUMNS), "judged")
    return rows.join(each, "raw").select(*COLUMNS, *(c for c in text.columns))
