"""Repository descriptions: commits, languages, presence checks, manifests, age."""

from pyspark.sql import Column, DataFrame, functions as F

from codelode.functions import formats
from codelode.operators import files as fl, history, manifests, repo as rp, repo_docs as docs
from codelode.operators.ranking import side_by_side


def repo_info(files: DataFrame, commits: DataFrame, repos: DataFrame, as_of: Column) -> DataFrame:
    """One row per repository. ``languages`` is ordered best first; NULL frameworks where none is named."""
    paths_only = files.select("repo_id", "path")
    breakdown = rp.language_breakdown_files(fl.file_language_wide(paths_only))
    shares = rp.languages_int(breakdown).groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "language", "pct"))).alias("shares")
    )
    names = manifests.manifest_frameworks(files).groupBy("repo_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "framework"))), lambda s: s["framework"]).alias(
            "frameworks"
        )
    )
    joined = side_by_side(repos.select("repo_id", "name", "path", "remote_url"), "repo_id", [
        history.commit_summary(commits, repos), shares, rp.primary_language(breakdown), docs.is_fork(repos),
        docs.repo_description(files, repos), names, docs.repo_has_tests(paths_only, repos),
        docs.repo_has_ci(paths_only, repos),
    ])
    languages = F.transform("shares", lambda s: F.struct(s["language"].alias("language"), s["pct"].alias("pct")))
    return joined.select(
        "repo_id", "name", "path", "commit_count", "user_commit_count", "first_commit_date", "last_commit_date",
        "primary_language",
        F.coalesce(languages, F.array().cast("array<struct<language:string,pct:int>>")).alias("languages"),
        "contributors", "is_fork", "remote_url", "description", "frameworks", "has_tests", "has_ci",
        formats.age_months(F.col("first_commit_date"), as_of).alias("age_months"),
    )


def discover_repos(info: DataFrame, min_commits: int = 10) -> DataFrame:
    return info.filter(F.col("commit_count") >= min_commits).orderBy("path")


def _portfolio(info: DataFrame, with_names: bool = False) -> DataFrame:
    """One row with the sums of all repositories and a bounded list of languages; with ``with_names`` also one per repository.

    ``info`` is read once: each repository brings its totals, its languages and its name as rows, which meet by partial sums. Rows with
    a null ``name_of`` are the totals, those of names have it.
    """
    none = F.lit(None)

    def entry(kind, key=none, pct=none, commits=none, first=none, last=none):
        return F.struct(
            F.lit(kind).alias("kind"), key.cast("string").alias("key"), pct.cast("bigint").alias("pct"), commits.cast("bigint").alias("commits"),
            first.cast("timestamp_ntz").alias("first"), last.cast("timestamp_ntz").alias("last"),
        )

    all_of_it = [entry("all", commits=F.col("commit_count"), first=F.col("first_commit_date"), last=F.col("last_commit_date"))]
    all_of_it += [entry("name", key=F.col("name"))] if with_names else []
    rows = F.concat(F.array(*all_of_it), F.transform("languages", lambda l: entry("language", key=l["language"], pct=l["pct"])))
    number = F.col("repo_id").alias("number")  # repositories may share a name
    entries = info.select(number, F.inline(rows)).withColumn("number", F.when(F.col("kind") == "name", F.col("number")))
    summed = entries.groupBy("kind", "key", "number").agg(
        F.sum("pct").alias("weight"), F.sum("commits").alias("commits"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    of_language = F.when(F.col("kind") == "language", F.struct(F.col("key").alias("language"), "weight"))
    return summed.groupBy("number", F.when(F.col("kind") == "name", F.col("key")).alias("name_of"), (F.col("kind") == "name").alias("is_name")).agg(
        F.collect_list(of_language).alias("weights"), F.coalesce(F.sum("commits"), F.lit(0)).cast("bigint").alias("total_commits"),
        F.min("first").alias("earliest"), F.max("last").alias("latest"),
    )


def _shares(weights: Column) -> Column:
    """(language, weight, pct) of each language, in whole percents of all."""
    total = F.aggregate(weights, F.lit(0).cast("bigint"), lambda s, w: s + w["weight"])
    return F.transform(weights, lambda w: F.struct(
        w["language"].alias("language"), w["weight"].alias("weight"), F.bround(w["weight"] * 100.0 / total, 0).cast("bigint").alias("pct")
    ))


def _told(column: str) -> Column:
    return F.coalesce(formats.iso(F.col(column)), F.lit("Unknown"))


def _portfolio_languages(weights: str) -> Column:
    ordered = F.array_sort(F.transform(_shares(F.col(weights)), lambda s: F.struct((-s["pct"]).alias("o"), s["language"].alias("language"), s["pct"].alias("pct"))))
    return formats.language_list(ordered)


def portfolio_rollup(info: DataFrame) -> DataFrame:
    """All repositories together: commits, language shares renormalised to 100, dates."""
    return _sums(info).select(
        "total_commits", _portfolio_languages("weights").alias("languages"), _told("earliest").alias("earliest"), _told("latest").alias("latest")
    )


def _sums(info: DataFrame) -> DataFrame:
    """The totals' row, which is there for no repositories too."""
    return _portfolio(info).agg(
        F.flatten(F.collect_list("weights")).alias("weights"), F.coalesce(F.sum("total_commits"), F.lit(0)).cast("bigint").alias("total_commits"),
        F.min("earliest").alias("earliest"), F.max("latest").alias("latest"),
    )


def portfolio_languages(info: DataFrame) -> DataFrame:
    """Share of each language over all repositories, in whole percents."""
    return _portfolio(info).select(F.inline(_shares(F.col("weights"))))


def portfolio_header(info: DataFrame) -> DataFrame:
    """Header fields of a portfolio; repository names stay one row each, as their number has no bound."""

    def line(at, field, value):
        return F.struct(F.lit(at).alias("line"), F.lit(field).alias("field"), value.alias("value"))

    fields = F.array(
        line(2, "Total Commits", F.col("total_commits").cast("string")), line(3, "Languages", _portfolio_languages("weights")),
        line(4, "Active Period", F.concat(_told("earliest"), F.lit(" to "), _told("latest"))),
    )
    return _portfolio(info, with_names=True).select(F.inline(F.when(F.col("is_name"), F.array(line(1, "Repositories", F.col("name_of")))).otherwise(fields)))
