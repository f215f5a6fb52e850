"""Studies, authors and the roles of contributors."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.ids import check_orcid

# The CRediT taxonomy, with short names.
CREDIT = {
    "con": ("Conceptualization", "Ideas; formulation or evolution of overarching research goals and aims."),
    "dat": ("Data curation", "Management activities to annotate (produce metadata), scrub data and maintain research data for initial use and later re-use."),
    "ana": ("Formal analysis", "Application of statistical, mathematical, computational, or other formal techniques to analyse or synthesize study data."),
    "fun": ("Funding acquisition", "Acquisition of the financial support for the project leading to this publication."),
    "inv": ("Investigation", "Conducting a research and investigation process, specifically performing the experiments, or data/evidence collection."),
    "met": ("Methodology", "Development or design of methodology; creation of models."),
    "adm": ("Project administration", "Management and coordination responsibility for the research activity planning and execution."),
    "res": ("Resources", "Provision of study materials, reagents, patients, samples, animals, instrumentation, computing resources, or other analysis tools."),
    "sof": ("Software", "Programming, software development; designing computer programs; implementation and testing of code."),
    "sup": ("Supervision", "Oversight and leadership responsibility for the research activity planning and execution."),
    "val": ("Validation", "Verification of the overall replication/reproducibility of results/experiments and other research outputs."),
    "vis": ("Visualization", "Preparation, creation and/or presentation of the published work, specifically visualization/data presentation."),
    "dra": ("Writing - original draft", "Preparation, creation and/or presentation of the published work, specifically writing the initial draft."),
    "edi": ("Writing - review & editing", "Preparation, creation and/or presentation of the published work, specifically critical review, commentary or revision."),
}


def credit_roles(display: str = "explain") -> list[str]:
    """The roles: explain, names or abbr."""
    if display == "abbr":
        return list(CREDIT)
    if display == "names":
        return [name for name, _ in CREDIT.values()]
    return [f"[{k}/{a}] {name}: {text}" for k, (a, (name, text)) in enumerate(CREDIT.items(), 1)]


def author(spark: SparkSession, surname: str, given: str = "", orcid: str | None = None, roles: list[str | int] = (), **more: Any) -> dict[str, Any]:
    """An author. roles: names, short names, or numbers of roles. An ORCID that is not valid becomes False."""
    names = credit_roles("names")
    known = {**{n: n for n in names}, **{a: n for a, (n, _) in CREDIT.items()}, **dict(enumerate(names, 1))}
    if bad := [r for r in roles if r not in known]:
        raise ValueError(f"These roles do not exist in the CRediT taxonomy: {', '.join(map(str, bad))}")
    if orcid is not None:
        orcid = spark.createDataFrame([(orcid,)], "o string").select(check_orcid(F.col("o"))).first()[0] or False
    return {"orcid": orcid, "name": {"surname": surname, "given": given}, "roles": [known[r] for r in roles], **more}


def study(name: str = "Demo Study", **info: Any) -> dict[str, Any]:
    return {"name": name, "info": info, "authors": [], "hypotheses": [], "methods": [], "data": [], "analyses": []}


def get_index(study: dict[str, Any], section: str = "hypotheses", id_: str | int | None = None) -> int:
    """The place of an item, by number (from 0) or id; that of a new one if there is none."""
    items = study[section]
    if isinstance(id_, int) and 0 <= id_ < len(items):
        return id_
    return next((k for k, x in enumerate(items) if id_ is not None and x.get("id") == id_), len(items))


def add_author(spark: SparkSession, study: dict[str, Any], surname: str, given: str = "", orcid: str | None = None, roles: list[str | int] = (), **more: Any) -> dict[str, Any]:
    """The study with one more author."""
    return {**study, "authors": [*study["authors"], author(spark, surname, given, orcid, roles, **more)]}
