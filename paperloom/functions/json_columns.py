"""JSON answers as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARSING_ERROR = "parsing error"
#: Distinct values that get a column each.
MOST = 1000


def few_values(df: DataFrame, column: str, most: int = MOST) -> list:
    """The values of a column that are to have a column each; more than most is an error, for some would vanish."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    _check(len(found), column, most)
    return sorted(found)


def _check(n: int, column: str, most: int) -> None:
    if n > most:
        raise ValueError(f"more than {most} distinct values of {column} to have a column each")


def _kind(kinds: list[str]) -> str:
    """The type that values of some kinds have in common: boolean, int, double or string."""
    found = set(kinds)
    if found == {"int", "double"}:
        return "double"
    return found.pop() if len(found) == 1 else "string"


def json_expand(df: DataFrame, column: str = "answer", fields: dict[str, str] | list[str] | None = None) -> DataFrame:
    """df with a column for each field of the JSON objects in a column, and error where the text is no JSON object.

    Lists become texts joined by "; ", of lists of objects each field so. fields: the fields, with types or without (then
    text). If not given, one aggregate over the data finds the names (in the order of their first place in an object) and the
    kinds of their values; more than MOST names are an error.
    """
    column = column if column in df.columns else df.columns[0]
    text = F.col(column)

    def listed(value):
        items = F.from_json(value, "array<string>")
        return F.when(value.startswith("["), F.coalesce(F.array_join(items, "; "), value)).otherwise(value)

    def joined(objects):
        names = F.array_distinct(F.flatten(F.transform(objects, F.map_keys)))
        each = lambda name: F.filter(F.transform(objects, lambda m: listed(F.try_element_at(m, name))), lambda v: v.isNotNull())
        return F.map_from_entries(F.transform(names, lambda name: F.struct(name, F.nullif(F.array_join(each(name), "; "), F.lit("")))))

    rows = df.withColumn("_json", F.try_parse_json(text))
    many = F.schema_of_variant("_json").startswith("ARRAY<OBJECT")
    rows = rows.withColumn("_map", F.when(many, joined(F.from_json(text, "array<map<string,string>>"))).otherwise(F.transform_values(F.from_json(text, "map<string,string>"), lambda _, v: listed(v))))
    types = fields if isinstance(fields, dict) else dict.fromkeys(fields or [], "string")
    if fields is None:
        value = F.col("value")
        kind = (
            F.when(value.isNull(), None)
            .when(value.isin("true", "false", "TRUE", "FALSE", "T", "F"), "boolean")
            .when(value.rlike(r"^[-+]?\d{1,9}$"), "int")
            .when(value.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), "double")
            .otherwise("string")
        )
        names = rows.select(F.posexplode("_map").alias("at", "k", "value")).groupBy("k").agg(F.min("at").alias("at"), F.collect_set(kind).alias("kinds"))
        found = names.limit(MOST + 1).collect()
        _check(len(found), "k", MOST)
        types = {r.k: _kind(r.kinds) for r in sorted(found, key=lambda r: (r.at, r.k))}
    field = lambda name, kind: F.try_element_at("_map", F.lit(name)).try_cast(kind)
    out = rows.withColumns({name: field(name, kind) for name, kind in types.items()})
    return out.withColumn("error", F.when(text.isNotNull() & F.col("_json").isNull(), F.lit(PARSING_ERROR))).drop("_json", "_map")
