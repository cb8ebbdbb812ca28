"""Where an import points: string functions, used inside extraction, and the same as column functions."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F


def python_relative(importing_file: str, module: str) -> str | None:
    """File of a module with leading dots, seen from a file; null for an absolute one. The first dot is the file's own folder."""
    name = module.lstrip(".")
    dots = len(module) - len(name)
    if not dots:
        return None
    folder = importing_file.split("/")[:-1]
    up = dots - 1
    folder = folder[: len(folder) - up] if up <= len(folder) else []
    parts = folder + (name.split(".") if name else [])
    return "/".join(parts) + ".py" if name else "/".join(parts)


def typescript_relative(importing_file: str, spec: str) -> str | None:
    """File of a ./ or ../ specifier; one without an extension takes the importer's. Null for a package."""
    if not spec.startswith(("./", "../")):
        return None
    path = posixpath.normpath(posixpath.join(posixpath.dirname(importing_file), spec))
    if "." not in path.rpartition("/")[2]:
        path += "." + importing_file.rpartition(".")[2]
    return path.removeprefix("../") if path.startswith("../") else path


def alias_target(importing_file: str, source: str, original: str | None, local: str) -> str:
    """What a name bound by an import stands for: import X as Y gives X, from M import X gives M>X, from . import M its file."""
    if source and not source.strip("."):
        folder = python_relative(importing_file, source) or ""
        return f"{folder}/{original or local}.py".lstrip("/")
    base = python_relative(importing_file, source) or source
    return f"{base}>{original}" if original else base


def chain(table: dict[str, str], path: str, most: int = 8) -> str:
    """Replaces the leading segment by what it stands for, again and again."""
    for _ in range(most):
        head, sep, rest = path.partition(">")
        if head not in table or table[head] == head:
            break
        path = table[head] + sep + rest
    return path


def python_relative_column(importing_file: Column, module: Column) -> Column:
    """python_relative() of two columns."""
    name = F.ltrim(module, F.lit("."))
    dots = F.length(module) - F.length(name)
    parts = F.split(importing_file, "/")
    folder = F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - dots))
    inside = F.when(name != "", F.split(name, r"\.")).otherwise(F.array().cast("array<string>"))
    return F.when(dots > 0, F.concat(F.array_join(F.concat(folder, inside), "/"), F.when(name != "", ".py").otherwise("")))


def typescript_relative_column(importing_file: Column, spec: Column) -> Column:
    """typescript_relative() of two columns."""
    parts = F.split(importing_file, "/")
    every = F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.split(spec, "/"))

    def step(kept: Column, part: Column) -> Column:
        up = (F.size(kept) > 0) & (F.coalesce(F.get(kept, F.size(kept) - 1), F.lit("")) != "..")
        return F.when(part.isin("", "."), kept).when((part == "..") & up, F.slice(kept, F.lit(1), F.greatest(F.lit(0), F.size(kept) - 1))).otherwise(F.concat(kept, F.array(part)))

    path = F.array_join(F.aggregate(every, F.array().cast("array<string>"), step), "/")
    full = F.when(F.contains(F.substring_index(path, "/", -1), F.lit(".")), path).otherwise(F.concat(path, F.lit("."), F.substring_index(importing_file, ".", -1)))
    return F.when(spec.startswith("./") | spec.startswith("../"), F.regexp_replace(full, r"^\.\./", ""))
