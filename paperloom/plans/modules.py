"""Check modules: a registry, how one is found and run, and what it returns.

A module is a function of a corpus that returns a dictionary (or only a table) with table, summary (a row for each id at most),
traffic_light, report and na_replace. Built-in modules register themselves; others are Python files, in which the first
function is the module and its docstring gives title and description.
"""

from __future__ import annotations

import importlib.util
import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import Corpus

LIGHTS = ("green", "yellow", "red", "info", "na", "fail")


@dataclass(frozen=True)
class Module:
    name: str
    run: Callable[..., Any]
    title: str
    description: str = ""
    details: str = ""
    imports: tuple[str, ...] = ()
    path: str = "built in"


@dataclass
class ModuleResult:
    module: str
    title: str
    table: DataFrame | None
    report: str
    traffic_light: str
    summary: DataFrame
    corpus: Corpus
    extra: dict[str, Any] = field(default_factory=dict)


REGISTRY: dict[str, Module] = {}


def module(title: str, description: str = "", details: str = "", imports: tuple[str, ...] = (), name: str | None = None):
    """Registers a function as a module."""

    def register(f):
        REGISTRY[name or f.__name__] = Module(name or f.__name__, f, title, description, details, imports)
        return f

    return register


def _builtin() -> dict[str, Module]:
    from . import builtin  # noqa: F401  registers them

    return REGISTRY


def _from_file(path: Path) -> Module:
    spec = importlib.util.spec_from_file_location(f"module_{path.stem}", path)
    code = importlib.util.module_from_spec(spec)
    try:
        spec.loader.exec_module(code)
    except ImportError as e:
        raise ImportError(f"The '{e.name}' package is required but not installed.") from e
    except Exception as e:
        raise ValueError(f"The module code has errors: {e}") from e
    functions = [f for f in vars(code).values() if inspect.isfunction(f) and f.__module__ == spec.name]
    if not functions:
        raise ValueError("The module code has errors: it has no function")
    f = min(functions, key=lambda f: f.__code__.co_firstlineno)
    title, _, description = inspect.cleandoc(f.__doc__ or code.__doc__ or path.stem).partition("\n")
    first, _, details = description.strip().partition("\n\n")
    return Module(path.stem, f, title.strip(), first.strip(), details.strip(), path=str(path))


def module_find(name: str) -> Module:
    """A module by name, from the registry, the working directory or its folder modules, or by path."""
    if name in _builtin():
        return REGISTRY[name]
    for path in (Path(f"{name}.py"), Path("modules") / f"{name}.py", Path(name)):
        if path.is_file():
            return _from_file(path)
    raise LookupError(f"There were no modules that matched {name}; use module_list() to see a list of built-in modules.")


def module_list(folder: str | None = None) -> list[dict[str, str]]:
    """name, title, description and path of the built-in modules, or of those in a folder; files with errors are left out."""
    found = list(_builtin().values())
    if folder is not None:
        found = []
        for path in sorted(Path(folder).rglob("*.py")):
            try:
                found.append(_from_file(path))
            except (ValueError, ImportError):
                continue
    return [{"name": m.name, "title": m.title, "description": m.description, "path": m.path} for m in found]


def module_info(name: str) -> dict[str, Any]:
    m = module_find(name)
    return {"title": m.title, "description": m.description, "details": m.details, "imports": m.imports, "function": m.run.__name__, "path": m.path}


def module_help(name: str | None = None) -> str:
    if name is None:
        return "\n".join(f"* {m['name']}: {m['description'] or m['title']}" for m in module_list())
    m = module_find(name)
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join([m.title, m.description or "{no description}", m.details])).strip()


TEMPLATE = '''def {name}(corpus, **options):
    """Title of the module

    What it finds.
    """
    from paperloom.operators.search import search_text
    from pyspark.sql import functions as F

    table = search_text(corpus, "significant")
    summary = table.groupBy("id").agg(F.count("*").alias("{name}"))
    return {{"table": table, "summary": summary, "na_replace": 0, "traffic_light": "info", "report": ""}}
'''


def module_template(name: str, folder: str = "modules") -> str:
    """Writes a module to start from, and returns its path."""
    if not re.fullmatch(r"[a-zA-Z0-9_]+", name):
        raise ValueError("The module name must contain only letters, numbers, and _")
    path = Path(folder) / f"{name}.py"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(TEMPLATE.format(name=name))
    return str(path)


def _join_summary(before: DataFrame, added: DataFrame, name: str, na_replace) -> DataFrame:
    """One more module's columns; names that are taken get the module's as an ending. Nulls in the new columns are replaced."""
    new = {c: f"{c}.{name}" if c in before.columns else c for c in added.columns if c != "id"}
    out = before.join(added.withColumnsRenamed(new), "id", "left")
    if na_replace is None:
        return out
    values = na_replace if isinstance(na_replace, dict) else dict.fromkeys(new, na_replace)
    values = {new[c]: v for c, v in values.items() if c in new}
    types = dict(out.dtypes)
    return out.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(v).cast(types[c])) for c, v in values.items()})


def module_run(source: Corpus | ModuleResult, name: str, **options) -> ModuleResult:
    """Runs a module on a corpus, or on another module's result, whose summary it then adds to."""
    m = module_find(name)
    corpus, summary = (source.corpus, source.summary) if isinstance(source, ModuleResult) else (source, source.ids())
    for package in m.imports:
        if importlib.util.find_spec(package) is None:
            raise ImportError(f"The '{package}' package is required but not installed.")
    try:
        found = m.run(corpus, **options)
    except Exception as e:
        raise RuntimeError(f"Running the module produced errors: {e}") from e
    found = {"table": found} if isinstance(found, DataFrame) else dict(found)
    table = found.pop("table", None)
    light = found.pop("traffic_light", None)
    if light is None:
        light = "na" if table is None or table.isEmpty() else "info"
    added, na_replace = found.pop("summary", None), found.pop("na_replace", None)
    if added is not None:
        summary = _join_summary(summary, added, m.name, na_replace)
    return ModuleResult(m.name, m.title, table, found.pop("report", "") or "", light, summary, corpus, found)
