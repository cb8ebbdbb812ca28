"""Column functions over symbol paths: segments joined by '>', the first one a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = ">"
LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "rs": "rust", "go": "go", "java": "java",
    "c": "c", "h": "c", "rb": "ruby", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp",
}


def is_symbol(path: Column) -> Column:
    return F.contains(path, F.lit(SEP))


def file_of(path: Column) -> Column:
    return F.substring_index(path, SEP, 1)


def name_of(path: Column) -> Column:
    return F.substring_index(path, SEP, -1)


def depth_of(path: Column) -> Column:
    return F.size(F.split(path, SEP))


def parent_of(path: Column) -> Column:
    """Null for a file."""
    return F.when(is_symbol(path), F.substring(path, F.lit(1), F.length(path) - F.length(name_of(path)) - 1))


def ancestors_of(path: Column) -> Column:
    """Proper prefixes, nearest first."""
    parts = F.split(path, SEP)
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), SEP))).otherwise(F.array().cast("array<string>"))


def is_valid(path: Column) -> Column:
    return (F.length(path) > 0) & ~path.rlike(r"(^>)|(>$)|(>>)|[\x00-\x1f]")


def extension_of(path: Column) -> Column:
    base = F.substring_index(file_of(path), "/", -1)
    return F.when(F.contains(base, F.lit(".")), F.substring_index(base, ".", -1))


def language_of(path: Column) -> Column:
    ext, out = extension_of(path), F.lit(None).cast("string")
    for language in sorted(set(LANGUAGES.values())):
        out = F.when(ext.isin([e for e, name in LANGUAGES.items() if name == language]), F.lit(language)).otherwise(out)
    return out
