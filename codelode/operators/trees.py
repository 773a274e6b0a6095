"""Directory trees and repository discovery from path listings."""

from pyspark.sql import Column, DataFrame, functions as F

from codelode import lexicons as lx
from codelode.functions import paths


def _hidden(name: Column) -> Column:
    return name.startswith(".") | name.isin(lx.LANGUAGE_SKIP)


def file_tree(files: DataFrame, max_depth: int = 3) -> DataFrame:
    """Visible entries down to ``max_depth`` directories, directories with a final slash.

    One row per entry; ``order`` (the components) sorts the listing as a directory walk.
    """
    p = paths.parts(F.col("path"))
    depths = F.sequence(F.lit(1), F.least(F.size(p), F.lit(max_depth + 1)))
    entries = F.transform(
        depths, lambda d: F.struct(F.slice(p, 1, d).alias("order"), (d < F.size(p)).alias("is_dir"))
    )
    shown = F.filter(entries, lambda e: ~F.exists(e["order"], _hidden))
    name = F.concat(F.array_join("order", "/"), F.when(F.col("is_dir"), "/").otherwise(""))
    return files.select("repo_id", F.inline(shown)).distinct().select(
        "repo_id", name.alias("entry"), F.size("order").alias("depth"), "is_dir", "order"
    )


def file_tree_nested(files: DataFrame, max_depth: int = 3) -> DataFrame:
    """The tree as (directory, child) rows; empty directories pruned, cut ones marked truncated."""
    p = paths.parts(F.col("path"))
    shown = F.least(F.size(p), F.lit(max_depth + 1))
    visible = files.filter(~F.exists(F.slice(p, 1, shown), _hidden))
    entries = F.transform(
        F.sequence(F.lit(1), shown),
        lambda d: F.struct(
            F.array_join(F.slice(p, 1, d - 1), "/").alias("directory"),
            F.element_at(p, d).alias("child"),
            (d < F.size(p)).alias("is_dir"),
            ((d < F.size(p)) & (d == max_depth + 1)).alias("truncated"),
        ),
    )
    return visible.select("repo_id", F.inline(entries)).distinct()


def find_repo_roots(listing: DataFrame, search_root: str, skip=lx.DISCOVERY_SKIP, max_depth: int = 10) -> DataFrame:
    """Directories below ``search_root`` that hold a ``.git`` directory.

    Hidden and skipped directories are not entered, nor are found repositories: of nested ones the
    outermost counts.
    """
    base = search_root.rstrip("/")
    below = F.split(F.substring("path", len(base) + 2, 1 << 30), "/")
    at = F.array_position(below, ".git")
    inside = listing.filter(F.col("path").startswith(f"{base}/")).select(below.alias("parts"), at.alias("at"))
    held = inside.filter((F.col("at") > 0) & (F.col("at") < F.size("parts")))
    root = F.slice("parts", 1, F.greatest(F.col("at") - 1, F.lit(0)).cast("int"))
    low = [s.lower() for s in skip]
    found = (
        held.select(root.alias("root"))
        .filter(F.size("root") <= max_depth)
        .filter(~F.exists("root", lambda d: d.startswith(".") | F.lower(d).isin(low)))
        .distinct()
    )
    outer = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("root")), lambda d: d < F.size("root")), lambda d: F.slice("root", 1, d)
    )
    nested = (
        found.select("root", F.explode(outer).alias("outer"))
        .join(found.select(F.col("root").alias("outer")), "outer", "left_semi")
        .select("root")
        .distinct()
    )
    path = F.array_join(F.concat(F.array(F.lit(base)), F.col("root")), "/")
    return found.join(nested, "root", "left_anti").select(path.alias("path"))


def new_repos(found: DataFrame, tracked: DataFrame) -> DataFrame:
    """Discovered repositories that are not tracked yet."""
    return found.join(tracked.select("path"), "path", "left_anti")
