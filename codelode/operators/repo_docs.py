"""Repository documentation and presence checks."""

from pyspark.sql import Column, DataFrame, functions as F

from codelode import lexicons as lx
from codelode.functions import paths, text


def any_row(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def per_repo(repos: DataFrame, flags: DataFrame) -> DataFrame:
    """All repositories with their flags, false where a repository has no matching file."""
    joined = repos.select("repo_id").join(flags, "repo_id", "left")
    return joined.na.fill(False)


def _exists(names) -> Column:
    return paths.exists_any(F.col("path"), names)


def _flags(files: DataFrame, repos: DataFrame, **conditions) -> DataFrame:
    """Presence flags; only files that show something reach the aggregate."""
    keep = F.lit(False)
    for condition in conditions.values():
        keep = keep | condition
    shown = files.filter(keep).groupBy("repo_id").agg(*[any_row(c).alias(n) for n, c in conditions.items()])
    return per_repo(repos, shown)


def repo_has_tests(files: DataFrame, repos: DataFrame) -> DataFrame:
    named = paths.basename(F.col("path")).rlike("(?s)^(?:" + "|".join(lx.TEST_NAME_PATTERNS) + r")\z")
    return _flags(files, repos, has_tests=_exists(lx.TEST_INDICATORS) | named)


def repo_has_ci(files: DataFrame, repos: DataFrame) -> DataFrame:
    return _flags(files, repos, has_ci=_exists(lx.CI_PATHS))


def doc_presence(files: DataFrame, repos: DataFrame) -> DataFrame:
    return _flags(
        files, repos,
        has_readme=_exists(lx.README_NAMES),
        has_docs_folder=F.col("path").startswith("docs/"),
        has_changelog=_exists(lx.CHANGELOG_NAMES),
        has_contributing=_exists([lx.CONTRIBUTING_NAME]),
    )


def is_config_only(files: DataFrame, repos: DataFrame) -> DataFrame:
    """Repositories named like configuration, or without a code file outside hidden directories."""
    code = files.filter(
        paths.suffix(F.col("path")).isin(lx.CODE_SUFFIXES) & ~F.col("path").rlike(r"(^|/)\.[^/]*/")
    ).select("repo_id").distinct()
    marked = repos.select("repo_id", "name").join(code.withColumn("has_code", F.lit(True)), "repo_id", "left")
    by_name = F.lower("name").isin(lx.CONFIG_REPO_NAMES)
    return marked.select("repo_id", (by_name | F.col("has_code").isNull()).alias("is_config_only"))


def is_fork(repos: DataFrame) -> DataFrame:
    return repos.select(
        "repo_id", F.coalesce(F.contains(F.lower("remote_url"), F.lit("fork")), F.lit(False)).alias("is_fork")
    )


def _readmes(files: DataFrame) -> DataFrame:
    if "is_text" in files.columns:  # one that does not decode falls to the next name
        files = files.filter("is_text")
    rank = F.array_position(F.array(*map(F.lit, lx.README_NAMES)), F.col("path"))
    return files.filter(F.col("path").isin(lx.README_NAMES)).select("repo_id", rank.alias("rank"), "content")


def readme_quality(files: DataFrame, repos: DataFrame) -> DataFrame:
    """none / minimal / basic / good / excellent, from the first README present."""
    content = F.col("content")
    score = F.lit(0)
    for section in lx.README_SECTIONS:
        found = F.lit(False)
        for word in section:
            found = found | F.contains(F.col("folded"), F.lit(word))
        score = score + found.cast("int")
    graded = _readmes(files).withColumn("folded", text.fold(content)).select(
        "repo_id", "rank", text.line_count(content).alias("lines"), score.alias("score")
    )
    quality = (
        F.when(F.col("lines") < 20, "minimal")
        .when((F.col("score") >= 4) & (F.col("lines") > 100), "excellent")
        .when((F.col("score") >= 2) & (F.col("lines") > 50), "good")
        .otherwise("basic")
    )
    best = graded.groupBy("repo_id").agg(F.min_by(quality, "rank").alias("quality"))
    return repos.select("repo_id").join(best, "repo_id", "left").select(
        "repo_id", F.coalesce("quality", F.lit("none")).alias("readme_quality")
    )


def repo_description(files: DataFrame, repos: DataFrame) -> DataFrame:
    """First prose line of the first README that has one, at most 200 characters."""
    inline = r"\t\x0b\f\r\x1c-\x1f\x85\p{Z}"
    prose = F.regexp_extract("content", rf"(?dm)^[{inline}]*([^#!{text.SPACE}][^\n]*)", 1)
    found = (
        _readmes(files)
        .select("repo_id", "rank", prose.alias("line"))
        .filter(F.col("line") != "")
        .groupBy("repo_id")
        .agg(F.min_by(F.substring(text.strip(F.col("line")), 1, 200), "rank").alias("description"))
    )
    return repos.select("repo_id").join(found, "repo_id", "left")


def readme_excerpt(files: DataFrame, n: int = 2000) -> DataFrame:
    """First characters of the first README present."""
    return _readmes(files).groupBy("repo_id").agg(F.min_by(F.substring("content", 1, n), "rank").alias("readme"))
