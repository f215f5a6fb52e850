"""The five tables of a corpus and their columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that every text table has; seq is the place in the document, which all joined-up text follows.
TEXT_COLUMNS = {"text": "string", "section": "string", "header": "string", "div": "int", "p": "int", "s": "int", "id": "string", "seq": "bigint"}
BIB_COLUMNS = ("xref_id", "ref", "doi", "bibtype", "title", "journal", "year", "authors", "volume", "issue", "fpage", "lpage", "id")
XREF_COLUMNS = ("xref_id", "type", "contents", "text", "id", "section", "div", "p", "s")

AFFILIATION = T.ArrayType(T.MapType(T.StringType(), T.StringType()))
AUTHOR = T.StructType(
    [
        T.StructField("orcid", T.StringType()),
        T.StructField("name", T.StructType([T.StructField("surname", T.StringType()), T.StructField("given", T.StringType())])),
        T.StructField("roles", T.ArrayType(T.StringType())),
        T.StructField("email", T.StringType()),
        T.StructField("affiliation", AFFILIATION),
    ]
)


def text_table(df: DataFrame) -> DataFrame:
    """df with every column of TEXT_COLUMNS; those it lacks are null, but seq, which then follows the rows as they come."""
    missing = [c for c in TEXT_COLUMNS if c not in df.columns]
    added = {c: F.lit(None).cast(TEXT_COLUMNS[c]) for c in missing if c != "seq"}
    if "text" in added:
        raise ValueError("a text table needs a column named text")
    if "seq" in missing:
        added["seq"] = F.monotonically_increasing_id()
    return df.withColumns(added) if added else df


def texts(spark: SparkSession, values: list[str | None]) -> DataFrame:
    """A text table of some strings, without places."""
    rows = [(k, v) for k, v in enumerate(values)]
    return text_table(spark.createDataFrame(rows, "seq long, text string"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str] | dict[str, str], how: str = "left") -> DataFrame:
    """Joins on keys where null equals null; the keys of the right side go. keys: names, or left name to right name."""
    keys = keys if isinstance(keys, dict) else {k: k for k in keys}
    right = right.withColumnsRenamed({r: f"_right_{r}" for r in keys.values()})
    on: Column | None = None
    for one, other in keys.items():
        same = F.col(one).eqNullSafe(F.col(f"_right_{other}"))
        on = same if on is None else on & same
    out = left.join(right, on, how)
    return out.drop(*(f"_right_{r}" for r in keys.values())) if how not in ("left_semi", "left_anti") else out


def ordered_text(column: str, order: str, separator: str) -> Column:
    """An aggregate: texts in order, joined; null texts are left out."""
    rows = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct(F.col(order).alias("o"), F.col(column).alias("t")))))
    return F.array_join(F.transform(rows, lambda x: x["t"]), separator)


@dataclass(frozen=True)
class Corpus:
    """Papers as five tables that share the column id."""

    info: DataFrame
    authors: DataFrame
    full_text: DataFrame
    bib: DataFrame
    xrefs: DataFrame

    TABLES = ("info", "authors", "full_text", "bib", "xrefs")

    @classmethod
    def of(cls, spark: SparkSession, info=None, authors=None, full_text=None, bib=None, xrefs=None) -> Corpus:
        """A corpus of some tables; those not given are empty."""
        empty = lambda schema: spark.createDataFrame([], schema)
        full_text = text_table(full_text) if full_text is not None else empty(", ".join(f"{c} {t}" for c, t in TEXT_COLUMNS.items()))
        if info is None:
            info = full_text.select("id").where("id IS NOT NULL").distinct()
        strings = lambda columns: ", ".join(f"{c} {'int' if c in ('div', 'p', 's') else 'string'}" for c in columns)
        if authors is None:
            authors = spark.createDataFrame([], T.StructType([T.StructField("id", T.StringType()), T.StructField("authors", T.ArrayType(AUTHOR))]))
        return cls(info, authors, full_text, bib if bib is not None else empty(strings(BIB_COLUMNS)), xrefs if xrefs is not None else empty(strings(XREF_COLUMNS)))

    def tables(self) -> dict[str, DataFrame]:
        return {t: getattr(self, t) for t in self.TABLES}

    def map(self, f) -> Corpus:
        return replace(self, **{t: f(df) for t, df in self.tables().items()})

    def ids(self) -> DataFrame:
        return self.info.select("id").distinct()

    def subset(self, ids: list[str] | DataFrame) -> Corpus:
        """The papers with some ids."""
        if isinstance(ids, DataFrame):
            return self.map(lambda df: df.join(ids.select("id").distinct(), "id", "left_semi"))
        return self.map(lambda df: df.where(F.col("id").isin(list(ids))))

    def union(self, other: Corpus) -> Corpus:
        """Both corpora; papers that are identical in both stay once."""
        return replace(self, **{t: a.unionByName(b, allowMissingColumns=True).dropDuplicates() if t != "authors" else a.unionByName(b).dropDuplicates(["id"]) for (t, a), b in zip(self.tables().items(), other.tables().values(), strict=True)})

    def overview(self) -> DataFrame:
        """(id, sections, sentences, references, citations) of each paper."""
        text = self.full_text.groupBy("id").agg(F.max("div").alias("sections"), F.count(F.lit(1)).alias("sentences"))
        out = self.ids().join(text, "id", "left")
        for name, table in (("references", self.bib), ("citations", self.xrefs)):
            out = out.join(table.groupBy("id").agg(F.count(F.lit(1)).alias(name)), "id", "left")
        return out.fillna(0)

    def write(self, path: str) -> None:
        for t, df in self.tables().items():
            df.write.mode("overwrite").parquet(f"{path}/{t}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Corpus:
        return cls(**{t: spark.read.parquet(f"{path}/{t}") for t in cls.TABLES})


def is_corpus(x) -> bool:
    return isinstance(x, Corpus)


def concat_tables(corpora: Corpus | list[Corpus], name: str) -> DataFrame:
    """One table of one or more corpora."""
    if name not in Corpus.TABLES:
        raise ValueError(f"a corpus has no table {name}")
    corpora = [corpora] if isinstance(corpora, Corpus) else corpora
    out = getattr(corpora[0], name)
    for more in corpora[1:]:
        out = out.unionByName(getattr(more, name), allowMissingColumns=True)
    return out
