"""Path expressions (``/``-separated, relative to the repository root)."""

from pyspark.sql import Column, functions as F


def parts(path: Column) -> Column:
    """Path components; ordering by them is the file order of a sorted directory walk."""
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last suffix with its dot; empty for dotfiles and names that end with a dot."""
    return F.regexp_extract(path, r"(?s)[^/](\.[^./]+)\z", 1)


def lower_suffix(path: Column) -> Column:
    return F.lower(suffix(path))


def has_part(path: Column, names) -> Column:
    """Is any component (directory or file name) one of the names?"""
    return F.arrays_overlap(parts(path), F.array(*map(F.lit, names)))


def ancestors(path: Column, limit: int | None = None) -> Column:
    """Directories above a path, outermost first; only the outermost ``limit`` if given."""
    p = parts(path)
    n = F.size(p) - 1
    if limit is not None:
        n = F.least(n, F.lit(limit))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(p, 1, i), "/"))).otherwise(
        F.array().cast("array<string>")
    )


def exists_any(path: Column, names) -> Column:
    """Does this file show that a file or directory of one of the names exists at the root?"""
    shown = F.substring_index(path, "/", 1).isin([n for n in names if "/" not in n])
    for name in names:
        if "/" in name:
            shown = shown | (path == name) | path.startswith(f"{name}/")
    return shown


def lookup(key: Column, table: dict) -> Column:
    """Value of a small literal table, NULL for other keys."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.create_map(*entries)[key]
