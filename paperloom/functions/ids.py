"""Identifiers: ORCID, DOI, OSF, and kinds of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a well-formed DOI looks like, and an OSF id.
DOI = r"^10\.\d{3,9}/[-._;()/:A-Za-z0-9]*[A-Za-z0-9]$"
OSF_ID = r"^[a-z0-9]{5}(_v\d+)?$"


def check_orcid(x: Column) -> Column:
    """The ORCID with hyphens, or null if its digits or check digit (ISO 7064, mod 11-2) are wrong."""
    digits = F.regexp_replace(x, "[^0-9X]", "")
    first = F.transform(F.sequence(F.lit(1), F.lit(15)), lambda i: F.try_to_number(F.substring(digits, i, F.lit(1)), F.lit("9")).cast("int"))
    total = F.aggregate(first, F.lit(0), lambda a, d: (a + d) * 2 % 11)
    check = (12 - total) % 11
    expected = F.when(check == 10, "X").otherwise(check.cast("string"))
    parts = [F.substring(digits, k, 4) for k in (1, 5, 9, 13)]
    return F.when((F.length(digits) == 16) & (F.substring(digits, 16, 1) == expected), F.concat_ws("-", *parts))


def doi_form(x: Column) -> Column:
    """Whether a text is a well-formed DOI; null is not."""
    return F.coalesce(x.rlike(DOI), F.lit(False))


def osf_id(x: Column) -> Column:
    """The OSF id in a text: an id, an address that ends in one, or one after osf.io/ anywhere; else null."""
    clean = F.lower(F.regexp_replace(x, r"\s", ""))
    path = F.regexp_replace(F.regexp_replace(clean, "^[a-z][a-z0-9+.-]*://[^/?#]*", ""), "[?#].*$", "")
    last = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    inside = F.regexp_extract(clean, r"osf\.io/([a-z0-9]{5}(?:_v\d+)?)(?:[?/]|$|[^a-z0-9_])", 1)
    return F.when(last.rlike(OSF_ID) | (F.length(last) == 24), last).when(F.length(inside).isin(5, 8, 9), inside)


# Kinds of files by extension. A file with several kinds has them joined.
FILE_TYPES = {
    "code": "r rmd qmd quarto rda rd rds ado dss jnlp rnw jl ipynb mat py sh c cpp h java js m pl php rb sql swift vb",
    "data": "rds rdata sav zsav por dta sas7bdat xpt sd7 jasp omv arff sav.gz csv.sav gen gdt gdtb dft wf1 dat json tsv csv xls xlsx ods numbers",
    "config": "gitignore git yml yaml config rproj",
    "stats": "sas por jasp sps spss do spv spo",
    "image": "ico png jpg jpeg gif bmp tif tiff svg eps webp",
    "text": "txt md doc docx odt rtf pdf tex log",
    "web": "html htm css xml",
    "archive": "zip tar gz 7z rar bz2",
    "audio": "mp3 wav flac ogg m4a",
    "video": "mp4 avi mov mkv webm",
    "slide": "ppt pptx odp key",
}


def file_types(spark: SparkSession) -> DataFrame:
    """(ext, type), one row for each extension."""
    kinds: dict[str, list[str]] = {}
    for kind, extensions in FILE_TYPES.items():
        for ext in extensions.split():
            kinds.setdefault(ext, []).append(kind)
    return spark.createDataFrame([(e, ";".join(k)) for e, k in sorted(kinds.items())], "ext string, type string")


def extension(name: Column) -> Column:
    """What follows a name's last full stop, in small letters (the whole name if it has none)."""
    return F.lower(F.substring_index(name, ".", -1))


def with_filetype(df: DataFrame, name: str = "name", column: str = "filetype") -> DataFrame:
    """df with the kinds of the files it names; null if unknown. The table of kinds has a fixed size, so it is broadcast."""
    types = file_types(df.sparkSession).select(F.col("ext").alias("_ext"), F.col("type").alias(column))
    return df.withColumn("_ext", extension(F.col(name))).join(F.broadcast(types), "_ext", "left").drop("_ext")


def file_category(name: Column, filetype: Column) -> Column:
    """code, data, codebook or readme, from a file's kind and name; null if neither tells."""
    has = lambda pattern: F.coalesce(name.rlike(f"(?i){pattern}"), F.lit(False))
    codebook = has("code[ _]?book") | has("data[ _]?dict")
    return (
        F.when(filetype.isin("stats", "code"), "code")
        .when(filetype == "data", "data")
        .when(codebook, "codebook")
        .when(has("read[ _-]?me"), "readme")
    )
