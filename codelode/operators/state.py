"""Saved profiles, stories and incremental state."""

from pyspark.sql import Column, DataFrame, functions as F

from codelode.functions import formats
from codelode.operators.ranking import page_rows, row_numbers, running_total
from codelode.sources.shared import write_shared


# --- profiles ------------------------------------------------------------------------------------------------------------------------


def list_profiles(profiles: DataFrame, last_profile: str | None) -> DataFrame:
    """Saved profiles, newest first."""
    sections = F.regexp_count("content", F.lit("## "))
    return profiles.select(
        "name", F.octet_length("content").cast("bigint").alias("size"), "modified",
        F.greatest(sections - 1, F.lit(0)).alias("project_count"),
        (F.concat("name", F.lit(".md")).eqNullSafe(F.lit(last_profile))).alias("synced"),
        "repo_count", "has_metadata",
    ).orderBy(F.desc("modified"), "name")


def latest_profile(profiles: DataFrame) -> DataFrame:
    return profiles.agg(F.max(F.struct("modified", "name")).alias("newest")).select(
        F.col("newest.name").alias("name"), F.col("newest.modified").alias("modified")
    )


def get_profile(profiles: DataFrame, name: str) -> DataFrame:
    return profiles.filter(F.col("name") == name)


def status_summary(listed: DataFrame) -> DataFrame:
    return listed.agg(
        F.count("*").alias("profiles_count"),
        F.max("modified").alias("last_analyze"),
        F.coalesce(F.bool_or(~F.col("synced")), F.lit(False)).alias("pending_sync"),
    )


def profiles_to_push(listed: DataFrame, name: str | None = None) -> DataFrame:
    """Profiles to push and what becomes of each: per-repository ones go, older ones without metadata fail."""
    chosen = listed.filter(F.col("name") == name) if name is not None else listed.filter(~F.col("synced"))
    return chosen.select("name", F.when(F.col("has_metadata"), "pushed").otherwise("failed").alias("status"))


def saved_names(profiles: DataFrame, existing: DataFrame, date: str) -> DataFrame:
    """File names for new profiles: ``repo_date``, then ``-1``, ``-2``, ... over what is taken.

    ``profiles(repo_name, ord)`` in order ``ord`` (unique); ``existing(name)``. Row j of a name takes the
    j-th free number. Taken numbers and new rows are merged on one line, ordered so that the number of
    taken ones before a row is how far the row has to move on.
    """
    named = profiles.withColumn("base", F.concat("repo_name", F.lit(f"_{date}")))
    bases = named.select("base").distinct()
    suffixed = r"(?s)^(.*)-([1-9]\d{0,17})\z"
    taken = (
        existing.select(F.col("name").alias("base"), F.lit(0).cast("bigint").alias("slot"))
        .union(
            existing.filter(F.col("name").rlike(suffixed)).select(
                F.regexp_extract("name", suffixed, 1), F.regexp_extract("name", suffixed, 2).cast("bigint")
            )
        )
        .join(bases, "base", "left_semi")
        .distinct()
    )
    numbered = row_numbers(named, ["base"], [F.col("ord")], "j")
    # a taken slot moves every row on whose free number is not below it
    before = row_numbers(taken, ["base"], [F.col("slot")], "i").select(
        "base", (F.col("slot") - (F.col("i") - 1)).alias("at"), F.lit(1).alias("is_taken"), F.col("slot").alias("tie"),
        F.lit(None).cast("string").alias("repo_name"), F.lit(None).cast("bigint").alias("ord"),
    )
    rows = numbered.select(
        "base", (F.col("j") - 1).alias("at"), F.lit(0).alias("is_taken"), F.col("j").alias("tie"), "repo_name",
        F.col("ord").cast("bigint").alias("ord"),
    )
    order = [F.col("at"), F.desc("is_taken"), F.col("tie")]
    moved = running_total(before.unionByName(rows), ["base"], order, F.col("is_taken"), "moved")
    slot = F.col("at") + F.col("moved")
    name = F.when(slot == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), slot.cast("string")))
    return moved.filter(F.col("is_taken") == 0).select("repo_name", "ord", name.alias("name"))


# --- stories ---------------------------------------------------------------------------------------------------------------------------


def stories_query(
    stories: DataFrame, repo_name: str | None = None, since: Column | None = None, technologies: str | None = None,
    limit: int = 50, offset: int = 0,
) -> DataFrame:
    """One page of stories, newest first, with the number of all that fit; an offset of any size costs the same."""
    fitting = stories
    if repo_name is not None:
        fitting = fitting.filter(F.col("repo_name") == repo_name)
    if since is not None:
        fitting = fitting.filter(F.col("last_commit_at") >= since)
    if technologies:
        wanted = [t.strip().lower() for t in technologies.split(",") if t.strip()]
        fitting = fitting.filter(
            F.arrays_overlap(F.transform("technologies", lambda t: F.lower(t)), F.array(*map(F.lit, wanted)))
        )
    # written once: the count, the order and the page's rows all read them
    fitting = write_shared(fitting, "fitting-stories")
    total = fitting.agg(F.count("*").alias("total")).scalar()
    order = [F.desc_nulls_last("last_commit_at"), F.col("story_id")]
    page = page_rows(fitting, ["last_commit_at", "story_id"], order, offset, limit)
    return page.withColumn("total", total)


def story_cards(stories: DataFrame) -> DataFrame:
    """Display fields of stories: at most five technologies, counts, date."""
    return stories.select(
        "story_id", F.coalesce("summary", F.lit("Untitled")).alias("summary"),
        F.array_join(F.slice("technologies", 1, 5), " ").alias("technologies"),
        F.concat_ws(
            " • ", F.coalesce("repo_name", F.lit("unknown")),
            F.concat(F.coalesce("files_changed", F.lit(0)).cast("string"), F.lit(" files")),
            F.concat(
                F.lit("+"), F.coalesce("lines_added", F.lit(0)).cast("string"), F.lit(" -"),
                F.coalesce("lines_removed", F.lit(0)).cast("string"),
            ),
            formats.story_date(formats.iso(F.col("last_commit_at"))),
        ).alias("details"),
    )


# --- incremental state -------------------------------------------------------------------------------------------------------------------


def repo_fingerprints(commits: DataFrame, repos: DataFrame) -> DataFrame:
    """Current state hash per repository path: newest commit and number of commits."""
    heads = commits.groupBy("repo_id").agg(F.min_by("sha", "walk_pos").alias("head"), F.count("*").alias("n"))
    return repos.select("repo_id", "path").join(heads, "repo_id", "left").select(
        "path", formats.repo_hash(F.col("head"), F.col("n")).alias("hash")
    )


def changed_repos(current: DataFrame, state: DataFrame) -> DataFrame:
    """Repositories whose hash is new or differs from the stored one."""
    known = state.select("path", F.col("hash").alias("known"))
    return current.join(known, "path", "left").filter(~F.col("hash").eqNullSafe(F.col("known"))).select("path", "hash")


def next_state(current: DataFrame, state: DataFrame) -> DataFrame:
    """Stored hashes after a successful run: current ones, and old ones of repositories not seen."""
    return current.select("path", "hash").unionByName(state.join(current, "path", "left_anti").select("path", "hash"))


def tracked_status(tracked: DataFrame, repos: DataFrame) -> DataFrame:
    """Tracked repositories with their name and whether they exist."""
    present = repos.select("path", F.lit(True).alias("found"))
    return tracked.join(present, "path", "left").select(
        "path", F.substring_index("path", "/", -1).alias("name"), "last_sync",
        F.coalesce("found", F.lit(False)).alias("exists"),
    )


def sync_plan(tracked: DataFrame, repos: DataFrame, commits: DataFrame, force: bool = False) -> DataFrame:
    """What a sync does with each tracked repository: sync, or skip as missing or unchanged."""
    newest = commits.groupBy("repo_id").agg(F.max("committed_date").alias("newest"))
    known = repos.select("repo_id", "path").join(newest, "repo_id", "left")
    due = F.lit(force) | F.col("last_sync").isNull() | F.coalesce(F.col("newest") > F.col("last_sync"), F.lit(False))
    reason = F.when(F.col("repo_id").isNull(), "not_found").when(~due, "unchanged")
    return tracked.join(known, "path", "left").select(
        "path", F.when(reason.isNull(), "sync").otherwise("skipped").alias("status"), reason.alias("reason")
    )


def sync_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status", "reason").agg(F.count("*").alias("n"))
