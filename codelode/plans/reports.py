"""Rendered text: commit blocks, headers and profiles."""

from pyspark.sql import DataFrame, functions as F

from codelode.functions import formats
from codelode.operators.history import commit_batches, commits_with_diffs
from codelode.operators.ranking import row_numbers


def commit_blocks(changes: DataFrame, max_files: int = 10, max_chars: int = 2000) -> DataFrame:
    """Text block per commit, from ``commits_with_diffs`` rows."""
    diff = F.when(
        F.col("diff") != "", F.concat(F.lit("\n```diff\n"), F.substring("diff", 1, max_chars), F.lit("\n```"))
    ).otherwise("")
    line = F.concat(F.lit("\n  "), formats.change_label(F.col("change_type")), F.lit(": "), "path", diff)
    kept = changes.withColumn("line", F.when(F.col("file_no") <= max_files, line))
    head = F.concat(
        F.lit("\nCommit: "), formats.sha8(F.col("sha")), F.lit("\nDate: "), "date", F.lit("\nMessage: "), "message",
        F.lit("\n\nFiles changed:"),
    )
    files = F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("file_no", "line"))))
    return (
        kept.withColumn("head", head)
        .groupBy("repo_id", "sha", "walk_pos")
        .agg(F.first("head").alias("head"), files.alias("files"))
        .select(
            "repo_id", "sha", "walk_pos",
            F.concat("head", F.array_join(F.transform("files", lambda f: f["line"]), "")).alias("block"),
        )
    )


def batch_texts(blocks: DataFrame, size: int = 25) -> DataFrame:
    """Blocks of each batch of ``size`` commits joined into one text."""
    batched = commit_batches(blocks, size)
    return (
        batched.groupBy("repo_id", "batch_num", "total_batches")
        .agg(F.array_sort(F.collect_list(F.struct("walk_pos", "block"))).alias("blocks"))
        .select(
            "repo_id", "batch_num", "total_batches",
            F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n---\n").alias("text"),
        )
    )


def commit_prompt_blocks(
    commits: DataFrame, commit_files: DataFrame, as_of, count: int = 200, days: int = 730, size: int = 25
) -> DataFrame:
    return batch_texts(commit_blocks(commits_with_diffs(commits, commit_files, as_of, count, days)), size)


def merge_summaries(summaries: DataFrame) -> DataFrame:
    """Non-blank batch summaries(repo_id, batch_num, summary), renumbered, as consecutive sections.

    A repository's text is its sections in order; they stay rows, as a long history has many.
    """
    kept = summaries.filter(F.col("summary").rlike(r"[^\s\x1c-\x1f\x85\p{Z}]"))
    numbered = row_numbers(kept, ["repo_id"], [F.col("batch_num")], "section")
    rule = F.when(F.col("section") > 1, "\n\n---\n\n").otherwise("")
    return numbered.select(
        "repo_id", "section",
        F.concat(rule, F.lit("## Batch "), F.col("section").cast("string"), F.lit("\n\n"), "summary").alias("text"),
    )


def metadata_header(info: DataFrame) -> DataFrame:
    """Markdown bullets that introduce a repository."""

    def bullet(title, value):
        return F.concat(F.lit(f"- **{title}**: "), value)

    def date(name):
        return F.coalesce(formats.iso(F.col(name)), F.lit("None"))

    period = F.concat(
        date("first_commit_date"), F.lit(" to "), date("last_commit_date"), F.lit(" ("),
        formats.age_long(F.col("age_months")), F.lit(")"),
    )
    header = F.concat_ws(
        "\n",
        bullet("Repository", F.col("name")),
        bullet("Languages", formats.language_list(F.col("languages"))),
        bullet("Total Commits", F.col("commit_count").cast("string")),
        bullet("Contributors", F.col("contributors").cast("string")),
        bullet("Active Period", period),
        bullet("Remote", formats.clean_remote_url(F.col("remote_url"))),
        F.when(F.col("is_fork"), "- **Fork**: Yes"),
    )
    return info.select("repo_id", header.alias("header"))


def offline_profile(info: DataFrame, analysis: DataFrame, found: DataFrame) -> DataFrame:
    """Markdown profile of each repository."""
    rows = (
        info.select("repo_id", "name", "primary_language", "commit_count", "age_months")
        .join(analysis.select("repo_id", "frameworks", "summary", "testing"), "repo_id")
        .join(found.select("repo_id", "features", "integrations", "achievements", "domain"), "repo_id")
    )
    meta = F.concat_ws(
        " | ",
        F.concat(F.lit("**"), "primary_language", F.lit("**")),
        F.concat(F.col("commit_count").cast("string"), F.lit(" commits")),
        formats.age_display(F.col("age_months")),
    )

    def section(condition, *lines):
        return F.when(condition, F.array(*lines))

    def bullets(items):
        return F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n")

    some = lambda c: F.size(c) > 0
    blank = F.lit("")
    always = F.lit(True)
    parts = [
        section(always, F.concat(F.lit("# "), "name"), blank, meta, blank),
        section(F.col("domain") != "", F.concat(F.lit("*"), formats.domain_title(F.col("domain")), F.lit(" Application*")), blank),
        section(some("frameworks"), F.concat(F.lit("**Frameworks:** "), F.array_join("frameworks", ", "))),
        section(
            always,
            F.concat(F.lit("**Codebase:** "), formats.thousands(F.col("summary.code_lines")), F.lit(" lines of code")),
            F.concat(F.lit("**Testing:** "), F.when(F.col("testing.has_tests"), "Has tests").otherwise("No tests detected")),
            blank,
        ),
        section(
            some("features"), F.lit("## What was built"), blank,
            bullets(F.transform(F.slice("features", 1, 6), lambda f: f["description"])), blank,
        ),
        section(
            some("integrations"),
            F.concat(
                F.lit("**Integrations:** "), F.array_join(F.transform(F.slice("integrations", 1, 8), lambda i: i["name"]), ", ")
            ),
            blank,
        ),
        section(
            some("achievements"), F.lit("## Key contributions"), blank,
            bullets(F.transform(F.slice("achievements", 1, 5), lambda a: formats.ellipsize(a))), blank,
        ),
        # Fixed value: closing line of a locally made profile, without a product name.
        section(always, F.lit("---"), F.lit("*Generated offline*")),
    ]
    present = F.flatten(F.filter(F.array(*parts), lambda p: p.isNotNull()))
    return rows.select("repo_id", F.array_join(present, "\n").alias("profile"))
