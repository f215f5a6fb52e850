"""How well a module finds what it should."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import normal_quantile
from ..schemas import Corpus, null_safe_join


@dataclass
class Validation:
    module: str
    observed: dict[str, Any]
    matches: dict[str, Any] = field(default_factory=dict)
    stats: dict[str, Any] = field(default_factory=dict)

    def __str__(self) -> str:
        out = [f"Validated matches for module `{self.module}`:", "", f"* N in validation sample: {self.stats['n_papers']}"]
        for name, values in self.stats.items():
            if isinstance(values, dict):
                out.append(f"* {name}:")
                whole = all(float(v).is_integer() for v in values.values())
                out += [f"  * {k}: {int(v) if whole else format(v, '.2f')}" for k, v in values.items()]
        return "\n".join(out)


def compare_summaries(expected: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Row by row on id: a table of which values are the same, and one row with the share of each column."""
    columns = [c for c in expected.columns if c != "id"]
    left = expected.select("id", *(F.col(c).alias(f"{c}_expected") for c in columns))
    right = observed.select("id", *(F.col(c).alias(f"{c}_observed") for c in columns))
    rows = left.join(right, "id", "full_outer").withColumns({c: F.col(f"{c}_expected").eqNullSafe(F.col(f"{c}_observed")) for c in columns})
    return rows, rows.agg(*(F.avg(F.col(c).cast("int")).alias(c) for c in columns))


def compare_tables(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """The rows of both tables, with expected, observed and match; null equals null."""
    columns = expected.columns
    observed = observed.select(*columns)
    flag = lambda df, e, o: df.withColumn("expected", F.lit(e)).withColumn("observed", F.lit(o)).withColumn("match", F.lit(e == o))
    hit = flag(null_safe_join(expected, observed, columns, "inner"), True, True)
    miss = flag(null_safe_join(expected, observed, columns, "left_anti"), True, False)
    extra = flag(null_safe_join(observed, expected, columns, "left_anti"), False, True)
    return hit.unionByName(miss).unionByName(extra)


def validate(corpus: Corpus, module: str, **expected) -> Validation:
    """Runs a module and compares its result with what is expected: table or summary (DataFrames with an id), or other fields."""
    from ..plans.modules import module_run

    result = module_run(corpus, module)
    found = {k: v for k, v in expected.items() if hasattr(result, k)}
    if not found:
        raise ValueError(f"The results of this module did not return any objects named: {', '.join(expected)}")
    out = Validation(module, {k: getattr(result, k) for k in found}, stats={"n_papers": corpus.ids().count()})
    for name, want in found.items():
        have = getattr(result, name)
        if not isinstance(want, DataFrame):
            out.matches[name] = want == have
            continue
        if "id" not in want.columns:
            raise ValueError(f"The `{name}` table must have an `id` column")
        if not set(want.columns) <= set(have.columns):
            raise ValueError(f"The `{name}` table did not have the same columns as the expected table")
        have = have.select(*want.columns)
        ids = want.select("id").distinct()
        one_each = want.count() == have.count() == ids.count() == out.stats["n_papers"] and not corpus.ids().join(ids, "id", "left_anti").count()
        if one_each:
            out.matches[name], shares = compare_summaries(want, have)
            out.stats[name] = shares.first().asDict()
        else:
            out.matches[name] = compare_tables(want, have)
            counts = {(r.expected, r.observed): r["count"] for r in out.matches[name].groupBy("expected", "observed").count().collect()}
            out.stats[name] = {"true_positive": counts.get((True, True), 0), "false_positive": counts.get((False, True), 0), "false_negative": counts.get((True, False), 0)}
    return out


def confusion(df: DataFrame, expected: str = "expected", observed: str = "observed", by: list[str] = ()) -> DataFrame:
    """hits, misses, false_alarms and correct_rejections of two boolean columns: one row, or one for each group."""
    e, o = F.col(expected), F.col(observed)
    return df.groupBy(*by).agg(F.count_if(e & o).alias("hits"), F.count_if(e & ~o).alias("misses"), F.count_if(~e & o).alias("false_alarms"), F.count_if(~e & ~o).alias("correct_rejections"))


def measures(df: DataFrame, expected: str = "expected", observed: str = "observed", by: list[str] = ()) -> DataFrame:
    """confusion() with signal detection measures. specificity is the rate of false alarms, as users of this measure expect here; true_specificity its complement."""
    counts = confusion(df, expected, observed, by)
    present, absent = F.col("hits") + F.col("misses"), F.col("false_alarms") + F.col("correct_rejections")
    # Never 0 or 1, whose normal quantiles are infinite; unknown if there is nothing to count.
    rate = lambda k, n: F.least(F.greatest(F.try_divide(k, n), F.try_divide(F.lit(0.5), n)), 1 - F.try_divide(F.lit(0.5), n))
    out = counts.withColumns({"sensitivity": rate(F.col("hits"), present), "specificity": rate(F.col("false_alarms"), absent), "accuracy": F.try_divide(F.col("hits") + F.col("correct_rejections"), present + absent)})
    out = out.withColumns({"true_specificity": 1 - F.col("specificity"), "_hit": normal_quantile(F.col("sensitivity")), "_alarm": normal_quantile(F.col("specificity"))})
    out = out.withColumns({"d_prime": F.col("_hit") - F.col("_alarm"), "beta": F.exp((F.col("_alarm") * F.col("_alarm") - F.col("_hit") * F.col("_hit")) / 2)})
    return out.select(*counts.columns, "accuracy", "sensitivity", "specificity", "true_specificity", "d_prime", "beta")


def accuracy(df: DataFrame, expected: str = "expected", observed: str = "observed") -> dict[str, float]:
    """The row of measures(); what is unknown is not a number."""
    return {k: math.nan if v is None else v for k, v in measures(df, expected, observed).first().asDict().items()}
