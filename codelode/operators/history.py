"""Commit history operators. ``walk_pos`` is 1 for the newest commit of a repository."""

import sys
from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codelode import lexicons as lx
from codelode.functions import formats, text
from codelode.operators.ranking import likely_rows, spread_join, top_k

# workers get this module's functions by value, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def commit_summary(commits: DataFrame, repos: DataFrame) -> DataFrame:
    """Counts, own commits and date range; dates are those of the walk's two ends."""
    who = repos.select("repo_id", "user_email", "user_name")
    own = F.coalesce(
        (F.coalesce(F.col("user_email"), F.lit("")) != "") & (F.col("author_email") == F.col("user_email")), F.lit(False)
    ) | F.coalesce(
        (F.coalesce(F.col("user_name"), F.lit("")) != "") & (F.col("author_name") == F.col("user_name")), F.lit(False)
    )
    # first reduce to one row per contributor: identities are then compared once per contributor
    authors = commits.groupBy("repo_id", "author_email", "author_name").agg(
        F.count("*").alias("n"),
        F.max(F.struct("walk_pos", "committed_date")).alias("oldest"),
        F.min(F.struct("walk_pos", "committed_date")).alias("newest"),
    )
    summed = (
        authors.join(who, "repo_id")
        .groupBy("repo_id")
        .agg(
            F.sum("n").alias("commit_count"),
            F.sum(F.when(own, F.col("n")).otherwise(0)).alias("user_commit_count"),
            F.max("oldest").alias("oldest"),
            F.min("newest").alias("newest"),
            F.count_distinct("author_email").alias("contributors"),
        )
    )
    return repos.select("repo_id").join(summed, "repo_id", "left").select(
        "repo_id",
        F.coalesce("commit_count", F.lit(0)).cast("bigint").alias("commit_count"),
        F.coalesce("user_commit_count", F.lit(0)).cast("bigint").alias("user_commit_count"),
        F.col("oldest.committed_date").alias("first_commit_date"),
        F.col("newest.committed_date").alias("last_commit_date"),
        F.coalesce("contributors", F.lit(0)).cast("bigint").alias("contributors"),
    )


def contributor_stats(commits: DataFrame) -> DataFrame:
    """Per contributor: latest name, commits, date range; ``newest_pos`` breaks ties in the report order."""
    return commits.groupBy("repo_id", F.col("author_email").alias("email")).agg(
        F.min_by("author_name", "walk_pos").alias("name"),
        F.count("*").alias("commits"),
        F.min("committed_date").alias("first_commit"),
        F.max("committed_date").alias("last_commit"),
        F.min("walk_pos").cast("bigint").alias("newest_pos"),
    )


def contributor_report(commits: DataFrame) -> DataFrame:
    """Contributors in report order: most commits first, then most recently seen."""
    return contributor_stats(commits).orderBy("repo_id", F.desc("commits"), "newest_pos")


def _within(commits: DataFrame, before: DataFrame) -> DataFrame:
    """Commits newer than a per-repository walk position; all where there is none."""
    return spread_join(commits, before, "repo_id", ["sha"], "left").filter(
        F.col("__stop").isNull() | (F.col("walk_pos") < F.col("__stop"))
    ).drop("__stop")


def commits_since(
    commits: DataFrame, as_of: Column, days: int = 365, count: int | None = None, since_date: Column | None = None,
    since_sha: str | None = None,
) -> DataFrame:
    """The newest commits up to the first one older than ``days`` before ``as_of``, at most ``count``.

    ``since_date`` keeps commits from that instant on; ``since_sha`` those newer than that commit.
    """
    cutoff = as_of - F.make_dt_interval(F.lit(days))
    stop = commits.filter(F.col("committed_date") < cutoff).groupBy("repo_id").agg(F.min("walk_pos").alias("__stop"))
    recent = commits if count is None else commits.filter(F.col("walk_pos") <= count)
    recent = _within(recent, stop)
    if since_date is not None:
        recent = recent.filter(F.col("committed_date") >= since_date)
    if since_sha is not None:
        named = commits.filter(F.col("sha").startswith(since_sha))
        at = named.groupBy("repo_id").agg(F.min("walk_pos").alias("__at"))
        recent = spread_join(recent, at, "repo_id", ["sha"]).filter(F.col("walk_pos") < F.col("__at")).drop("__at")
    return recent


def _file_stats(commit_files: DataFrame) -> DataFrame:
    # dealt out once, by commit: both groupings and the join with commits then need no further shuffle
    changed = commit_files.select("repo_id", "sha", "path", "insertions", "deletions").repartition("repo_id", "sha")
    per_path = changed.groupBy("repo_id", "sha", "path").agg(
        F.sum("insertions").cast("bigint").alias("insertions"), F.sum("deletions").cast("bigint").alias("deletions")
    )
    return per_path.groupBy("repo_id", "sha").agg(
        F.count("*").alias("files_changed"),
        F.sum("insertions").alias("insertions"),
        F.sum("deletions").alias("deletions"),
    )


def commit_stats(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """One row per commit: short sha, subject, changed files and line totals."""
    return commits.join(_file_stats(commit_files), ["repo_id", "sha"], "left").select(
        "repo_id", formats.sha8(F.col("sha")).alias("sha"), F.col("sha").alias("full_sha"),
        formats.subject(F.col("message")).alias("message"), F.col("author_name").alias("author"), "author_email",
        formats.iso(F.col("committed_date")).alias("date"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("files_changed", "insertions", "deletions")],
    )


def commit_detail(commits: DataFrame, commit_files: DataFrame, sha: str) -> DataFrame:
    """Changed files of the commit that a full or short sha names, with the commit's totals.

    A short sha that fits several commits of a repository gives one error row for it.
    """
    found = commits.filter(F.col("sha").startswith(sha))
    fits = found.groupBy("repo_id").agg(F.count("*").alias("fits"))
    # the prefix also reaches the file rows, so both scans are filtered before the join
    changed = (
        commit_files.filter(F.col("sha").startswith(sha))
        .groupBy("repo_id", "sha", "path")
        .agg(F.sum("insertions").cast("bigint").alias("insertions"), F.sum("deletions").cast("bigint").alias("deletions"))
    )
    totals = changed.groupBy("repo_id", "sha").agg(
        F.sum("insertions").alias("total_insertions"), F.sum("deletions").alias("total_deletions")
    )
    unique = F.col("fits") == 1
    detail = (
        found.join(fits, "repo_id")
        .join(totals, ["repo_id", "sha"], "left")
        .join(changed, ["repo_id", "sha"], "left")
        .filter(unique)
        .select(
            "repo_id", formats.sha8(F.col("sha")).alias("sha"), F.col("sha").alias("full_sha"),
            text.strip(F.col("message")).alias("message"), F.col("author_name").alias("author"), "author_email",
            formats.iso(F.col("committed_date")).alias("date"), "path", "insertions", "deletions",
            F.coalesce("total_insertions", F.lit(0)).cast("bigint").alias("total_insertions"),
            F.coalesce("total_deletions", F.lit(0)).cast("bigint").alias("total_deletions"),
            F.lit(None).cast("string").alias("error"),
        )
    )
    ambiguous = fits.filter(~unique).select(
        "repo_id", F.concat(F.lit("Ambiguous commit: "), F.lit(sha)).alias("error")
    )
    return detail.unionByName(ambiguous, allowMissingColumns=True)


def commit_batches(commits: DataFrame, size: int = 25) -> DataFrame:
    """Batch number of every commit and the number of batches of its repository."""
    batch = (F.floor((F.col("walk_pos") - 1) / size) + 1).cast("bigint")
    last = commits.groupBy("repo_id").agg(F.max("walk_pos").alias("last"))
    total = (F.floor((F.col("last") - 1) / size) + 1).cast("bigint")
    return spread_join(commits, last, "repo_id", ["sha"]).withColumns({"batch_num": batch, "total_batches": total}).drop("last")


def commits_with_diffs(
    commits: DataFrame, commit_files: DataFrame, as_of: Column, count: int = 100, days: int = 365, max_lines: int = 50,
    max_files: int = 10,
) -> DataFrame:
    """Recent commits with the first files of each and their shortened diffs.

    A filter of the recent commits' keys is broadcast to the scan of the files, so diffs of older commits are read but neither
    shortened nor shuffled. The first files of a commit are chosen before the shuffle as well, by commit; the join with the
    commits then needs no further one.
    """
    keys = ["repo_id", "sha"]
    recent = commits_since(commits, as_of, days, count)
    order = [F.col(c) for c in ("file_pos", "path", "change_type", "insertions", "deletions")]
    likely = likely_rows(commit_files, recent, keys).select(
        *keys, "file_pos", "path", "change_type", "insertions", "deletions",
        formats.truncate_diff(F.col("diff"), max_lines).alias("diff"),
    )
    first = top_k(likely, keys, order, max_files, "file_no").select(*keys, "file_no", "path", "change_type", "diff")
    return recent.join(first, keys, "left").select(
        *keys, "walk_pos", text.strip(F.col("message")).alias("message"), "author_name", "author_email",
        formats.iso(F.col("committed_date")).alias("date"), "file_no", "path", "change_type", "diff",
    )


# --- achievements --------------------------------------------------------------------------------------------------------------------


def _tails(low: Column) -> Column:
    """What each achievement pattern captures, in pattern order; only captures of more than five characters."""
    found = F.array(*[F.regexp_extract(low, text.java_regex(pattern), 1) for pattern in lx.ACHIEVEMENT_PATTERNS])
    clean = lambda t: F.substring(F.regexp_replace(text.strip(t), f"[{text.SPACE}]+", " "), 1, 100)
    return F.filter(F.transform(F.filter(found, lambda t: t != ""), clean), lambda t: F.length(t) > 5)


def _fold(k: int, schema: pa.Schema):
    """Rows (repo_id, walk_pos, subject, length, tails) in walk order, repository by repository, to the ``k`` longest subjects told of each.

    Held are the digests of what one repository has told, some 110 bytes each, and ``k`` subjects.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo, seen, best, out = None, set(), [], []

        def flush(rows):
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in rows], schema)

        for batch in batches:
            subjects = batch.column("subject")
            for i, (r, at, length, tails) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("repo_id", "walk_pos", "length", "tails")))):
                if r != repo:
                    out += [(repo, n, subject) for n, (*_, subject) in enumerate(best, 1)]
                    repo, seen, best = r, set(), []
                fresh = next((t for t in tails if t not in seen), None)
                if fresh is not None:
                    seen.add(fresh)
                    if len(best) < k or (-length, at) < best[-1][:2]:
                        insort(best, (-length, at, subjects[i].as_py()))
                        del best[k:]
            if len(out) >= 1000:
                yield flush(out)
                out = []
        yield flush(out + [(repo, n, subject) for n, (*_, subject) in enumerate(best, 1)])

    return fold


def achievements(commits: DataFrame, n: int | None = 200, k: int = 15) -> DataFrame:
    """Subjects among the newest ``n`` commits, or all, that tell of an achievement not told before, longest first.

    A subject counts if one of its captures is new; which captures are taken depends on the subjects before it, so those of a
    repository are folded one after another, in walk order, in one task that reads them as a stream. Only subjects with a verb that
    a pattern starts with get there. Captures count as equal when their MD5 digests agree.
    """
    verbs = "|".join(text.java_regex(p.partition(r"\s+")[0]) for p in lx.ACHIEVEMENT_PATTERNS)

    def told_of(subject):
        low, stopped = F.lower(subject), F.lit(False)
        for word in lx.SUBJECT_STOP_WORDS:
            stopped = stopped | F.contains(low, F.lit(word))
        return (F.length(subject) > 10) & ~stopped & low.rlike(verbs)

    walked = commits.filter(F.col("walk_pos").isNotNull() if n is None else F.col("walk_pos") <= n)
    # a list of one or none, so that the subject is cut out of its message once
    subjects = F.filter(F.array(formats.subject(F.col("message"))), told_of)
    told = walked.select("repo_id", F.col("walk_pos").cast("bigint").alias("walk_pos"), F.explode(subjects).alias("subject"))
    digests = F.transform(_tails(F.lower("subject")), lambda t: F.unhex(F.md5(t)))
    told = told.select("*", F.length("subject").alias("length"), digests.alias("tails"))
    told = told.repartition("repo_id").sortWithinPartitions("repo_id", "walk_pos", "subject")
    form = T.StructType([commits.schema["repo_id"], T.StructField("position", T.IntegerType()), T.StructField("subject", T.StringType())])
    return told.mapInArrow(_fold(k, to_arrow_schema(form)), form)
