"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def extension(path: Column) -> Column:
    """As os.path.splitext: '' for a name that only starts with dots."""
    return F.regexp_extract(base_name(path), r"^\.*[^.].*(\.[^.]*)$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """'' for a file at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    name, ext = base_name(path), extension(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ext))


def path_module(path: Column) -> Column:
    """First three segments; the whole path if there are fewer."""
    return F.concat_ws("/", F.slice(F.split(path, "/", -1), 1, 3))


def path_root(module: Column, path: Column) -> Column:
    """Top-level directory of the module, or of the path where the module is empty."""
    return F.substring_index(slashes(F.when(F.coalesce(module, F.lit("")) != "", module).otherwise(path)), "/", 1)


def under(path: Column, prefix: str) -> Column:
    return (path == prefix) | path.startswith(prefix + "/")


def in_scope(path: Column, exclude: list[str], include: list[str]) -> Column:
    """Excluded prefixes win; with an allow-list, only what it names. Prefixes end at a path boundary."""
    path, out = slashes(path), F.lit(True)
    for p in exclude:
        out = out & ~under(path, p)
    if include:
        allowed = F.lit(False)
        for p in include:
            allowed = allowed | under(path, p)
        out = out & allowed
    return out


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first, without the root."""
    parts = F.split(path, "/", -1)
    depth = F.size(parts) - 1
    return F.when(depth > 0, F.transform(F.sequence(depth, F.lit(1), F.lit(-1)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))).otherwise(F.array().cast("array<string>"))
