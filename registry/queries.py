"""Registered queries: name -> function of the tables of one data folder."""

import uuid

from pyspark.sql import DataFrame, functions as F

from codelode import lexicons as lx
from codelode.functions import formats
from codelode.operators import (
    files as fl, history, manifests, repo as rp, repo_docs as docs, rule_tables, rules, search, search_index, state, trees,
)
from codelode.plans import analysis, highlights as hl, incremental, repo_info as ri, reports
from codelode.sources import sinks
from codelode.sources.commit_log import number_commits, walk_commits
from codelode.sources.shared import shared_folder, write_shared
from codelode.streaming import commits as stream
from registry.fixtures import Tables

DATE = "2001-08-02"


def instant(day: str = DATE):
    return F.lit(f"{day} 00:00:00").cast("timestamp_ntz")


def with_imports(df: DataFrame) -> DataFrame:
    return df.withColumn("imports", F.array_join("imports", ","))


def files_view(df: DataFrame) -> DataFrame:
    return df.select("repo_id", "path")


def hits(t: Tables) -> DataFrame:
    return rules.file_rule_hits(t.files)


def stored_hits(t: Tables) -> DataFrame:
    """Written once, for queries that read them in several branches."""
    return write_shared(hits(t), "rule-hits")


def info(t: Tables) -> DataFrame:
    return ri.repo_info(t.files, t.commits, t.repos, instant())


def endpoints(t: Tables) -> DataFrame:
    facts = write_shared(analysis.file_facts(t.files).select("repo_id", "path", "frameworks", "endpoints"), "file-facts")
    return rp.api_endpoints(analysis.endpoint_facts(facts), analysis.framework_facts(facts))


def imports(t: Tables) -> DataFrame:
    return fl.file_imports(fl.file_metrics(t.files))


def overview(t: Tables) -> DataFrame:
    metrics = fl.line_metrics(t.files)
    rolled = metrics.groupBy("repo_id").agg(
        F.count("*").alias("total_files"), F.sum("lines_code").cast("bigint").alias("code_lines"),
        F.bround(F.sum("lines_comment") * 100.0 / F.sum("lines_total"), 1).alias("comment_pct"),
    )
    shares = rp.language_breakdown_loc(metrics).drop("position")
    return rolled.join(shares, "repo_id", "left")


def read_requests(t: Tables) -> DataFrame:
    return (
        t.commit_files.select("repo_id", "path")
        .union(t.files.select("repo_id", "path"))
        .union(t.repos.select("repo_id", F.lit("docs")))
    )


def read_files(t: Tables) -> DataFrame:
    return search.read_file(t.files, read_requests(t), 40).withColumn("content", F.md5("content"))


def repo_analysis(t: Tables) -> DataFrame:
    a = analysis.analyze(t.files, t.repos)

    def told(column, form):
        return F.array_join(F.transform(column, form), ",").alias(column)

    return a.select(
        "repo_id", "summary.*",
        F.array_join(
            F.transform(F.map_entries("languages"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ","
        ).alias("languages"),
        *[F.array_join(c, ",").alias(c) for c in ("frameworks", "notable_libraries", "architecture")],
        "quality.*", "testing.has_tests", "testing.test_files", "testing.test_ratio",
        F.array_join("testing.test_frameworks", ",").alias("test_frameworks"), "documentation.*",
        told("api_endpoints", lambda e: F.concat_ws(" ", e["method"], e["path"], e["file"])),
        *[F.array_join(c, ",").alias(c) for c in ("key_files", "entry_points")],
        told("most_used_imports", lambda e: F.concat(e["name"], F.lit(":"), e["count"].cast("string"))),
    )


def info_row(t: Tables) -> DataFrame:
    return info(t).withColumns(
        {"languages": formats.language_list(F.col("languages")), "frameworks": F.array_join("frameworks", ",")}
    )


def highlight_rows(t: Tables) -> DataFrame:
    h = hl.highlights(t.files, t.commits, t.repos, newest=None)
    feature = lambda f: F.concat_ws("|", f["name"], f["confidence"].cast("string"), F.array_join(f["evidence_files"], ","))
    return h.select(
        "repo_id", "name", F.array_join(F.transform("features", feature), ";").alias("features"),
        F.array_join(F.transform("integrations", lambda i: i["name"]), ",").alias("integrations"),
        F.array_join("achievements", ",").alias("achievements"), "domain",
        F.array_join("scale_indicators", ",").alias("scale_indicators"),
        F.array_join("skills_demonstrated", ",").alias("skills_demonstrated"),
    )


def commit_ages(t: Tables) -> DataFrame:
    months = t.commits.select("sha", formats.age_months(F.col("committed_date"), instant()).alias("age_months"))
    m = F.col("age_months")
    return months.select(
        "sha", m, formats.age_display(m).alias("age_display"), formats.age_long(m).alias("age_long"),
        formats.format_duration(m).alias("duration"),
    )


def file_sizes(t: Tables) -> DataFrame:
    factor = F.element_at(F.array(*[F.lit(float(f)) for f in (1, 1e3, 1e6, 1e9, 1e11)]), F.col("repo_id") % 5 + 1)
    return t.files.select("repo_id", "path", formats.format_bytes(F.octet_length("content") * factor).alias("size"))


def commit_labels(t: Tables) -> DataFrame:
    # diffs are long: each is shortened and digested where it is read, before its row meets the commit's
    shown = t.commit_files.select(
        "repo_id", "sha", "file_pos", "path", formats.change_label(F.col("change_type")).alias("label"),
        F.md5(formats.truncate_diff(F.col("diff"), 20)).alias("diff"),
    )
    told = t.commits.select("repo_id", "sha", formats.subject(F.col("message")).alias("subject"))
    return told.join(shown, ["repo_id", "sha"]).select(
        F.substring("sha", -8, 8).alias("tail"), formats.sha8(F.col("sha")).alias("sha8"), "subject", "file_pos", "path", "label", "diff",
    )


def story_dates(t: Tables) -> DataFrame:
    iso, pos = formats.iso(F.col("committed_date")), F.col("walk_pos") % 4
    written = F.when(pos == 0, F.concat(iso, F.lit("Z"))).when(pos == 1, F.concat(iso, F.lit("+02:00"))).when(
        pos == 2, "no date at all"
    )
    return t.commits.select("sha", formats.story_date(written).alias("date"))


def saved_names(t: Tables) -> DataFrame:
    documents = t.spark.read.parquet(f"{t.folder}/documents.parquet")
    profiles = documents.select(F.col("lang").alias("repo_name"), F.col("doc_id").alias("ord"))
    slot = F.floor(F.col("doc_id") / 5)
    base = F.concat("lang", F.lit(f"_{DATE}"))
    existing = documents.filter(F.col("doc_id") % 7 == 0).select(
        F.when(slot == 0, base).otherwise(F.concat(base, F.lit("-"), slot.cast("string"))).alias("name")
    ).distinct()
    return state.saved_names(profiles, existing, DATE)


def committed_profiles(t: Tables) -> DataFrame:
    """Profiles named by language, written by two writers in turn."""
    documents = t.spark.read.parquet(f"{t.folder}/documents.parquet")
    rows = documents.select(F.col("lang").alias("repo_name"), F.col("doc_id").alias("ord"), F.md5("text").alias("content"), "source")
    rows = rows.withColumnRenamed("source", "metadata")
    path = f"{shared_folder(t.spark)}/profiles-{uuid.uuid4().hex}"
    for turn in range(2):
        sinks.ProfileStore(t.spark, path).save(rows.filter(F.col("ord") % 2 == turn), DATE)
    return sinks.ProfileStore(t.spark, path).read()


def changed_files(t: Tables) -> DataFrame:
    """Two listings of the same files: of the earlier one some are missing, some differ, and some are gone since."""
    listed = t.files.select("repo_id", "path", F.md5("content").alias("stamp"))
    size, of_length = F.length("path"), F.length("path") % 13
    current = listed.filter(of_length != 5)
    known = listed.filter(of_length != 3).withColumn("stamp", F.when(size % 17 == 1, "old").otherwise(F.col("stamp")))
    changed, gone = incremental.changed_files(current, known)
    return changed.withColumn("kind", F.lit("changed")).unionByName(gone.withColumns({"stamp": F.lit(None).cast("string"), "kind": F.lit("gone")}))


def stored_state(t: Tables) -> DataFrame:
    current = state.repo_fingerprints(t.commits, t.repos).join(t.repos.select("path", "repo_id"), "path")
    kept = current.filter(F.col("repo_id") % 5 != 4).select(
        "path", F.when(F.col("repo_id") % 2 == 0, "stale").otherwise(F.col("hash")).alias("hash")
    )
    gone = t.repos.filter(F.col("repo_id") % 5 == 4).select(F.concat("path", F.lit("-old")), F.lit("gone"))
    return kept.union(gone)


def merged_summaries(t: Tables) -> DataFrame:
    summaries = t.commits.select(
        "repo_id", F.col("walk_pos").alias("batch_num"),
        F.when(F.col("walk_pos") % 3 == 0, "  \n").otherwise(F.col("message")).alias("summary"),
    )
    return reports.merge_summaries(summaries)


def listed_profiles(t: Tables) -> DataFrame:
    return state.list_profiles(t.profiles, "en_7.md")


def push_summary(t: Tables) -> DataFrame:
    results = state.profiles_to_push(listed_profiles(t)).withColumn("reason", F.lit(None).cast("string"))
    return state.sync_summary(results)


def stories_page(t: Tables) -> DataFrame:
    since = instant("1998-01-01")
    page = state.stories_query(t.stories, since=since, technologies="Python, sql", limit=50, offset=20)
    return page.drop("summary", "technologies")


def repo_roots(t: Tables) -> DataFrame:
    return trees.find_repo_roots(t.listing, "/code")


def streamed_contributors(t: Tables) -> DataFrame:
    """Feed all commits in parts: most, then late duplicates with stale positions, then late firsts by a stream of their own."""
    folder = f"{shared_folder(t.spark)}/feed-{uuid.uuid4().hex}"
    position, target = F.col("walk_pos"), f"{folder}/out"
    commits = write_shared(t.commits, "feed-commits")  # numbered once for all parts
    late = position % 5 == 0
    parts = [
        ("a", commits.filter(~late), "2001-08-20"), ("a", commits.filter(position % 3 == 0).withColumn("walk_pos", position + 7), "2001-09-21"),
        ("a", commits.filter(late & (position % 2 == 0)), "2001-08-01"), ("b", commits.filter(late), "2001-07-01"),
    ]
    for name, part, day in parts:
        part.withColumn("ingest_ts", F.lit(day).cast("timestamp")).write.mode("append").json(f"{folder}/in-{name}")
        stream.stream_commits(t.spark, f"{folder}/in-{name}", target, f"{folder}/checkpoint-{name}").awaitTermination()
    return stream.contributor_table(t.spark, target)


def comment_lines(t: Tables) -> DataFrame:
    """Comment lines per source file, judged line by line."""
    source = fl.collect_source_files(t.files).join(fl.file_language(t.files), ["repo_id", "path"])
    lines = F.filter(F.split("content", "\n"), lambda line: fl.is_comment_line(line, F.col("language")))
    return source.select("repo_id", "path", F.size(lines).alias("lines_comment"))


def rule_table(t: Tables) -> DataFrame:
    """The lexicons as rows, an integration named like each repository, and a feature for each second word of a part's name."""
    named = t.fixture("fx_seed").select(
        F.lit("integration"), (F.col("repo_id") + 10_000).cast("int"), "label", F.lit(0), F.lower("label")
    )
    word = F.split("p_name", " ")[1]
    parts = t.spark.read.parquet(f"{t.folder}/part.parquet").groupBy(word.alias("word")).agg(F.min("p_partkey").alias("first"))
    nouns = parts.select(F.lit("feature"), (F.col("first") + 10_000).cast("int"), "word", F.lit(0), F.lower("word"))
    return write_shared(rules.rule_rows(t.spark).union(named).union(nouns), "rule-rows")


def table_rule_integrations(t: Tables) -> DataFrame:
    given = rule_table(t)
    return rules.detect_integrations(rule_tables.rule_table_hits(t.files, given), given)


def table_rule_features(t: Tables) -> DataFrame:
    given = rule_table(t)
    return rules.detect_features(rule_tables.rule_table_hits(t.files, given), lexicons=given)


SINCE_SHA = "0" * 37  # commits of a few orders

QUERIES = {
    "repo_code_overview": overview,
    # files
    "source_files": lambda t: files_view(fl.collect_source_files(t.files)),
    "visible_files": lambda t: files_view(fl.exclude_paths(t.files, lx.DISCOVERY_SKIP, hidden_dirs=True, ignore_case=True)),
    "file_language": lambda t: fl.file_language(t.files),
    "file_language_wide": lambda t: fl.file_language_wide(t.files),
    "line_metrics": lambda t: fl.line_metrics(t.files),
    "comment_lines": comment_lines,
    "js_metrics": lambda t: fl.js_metrics(t.files),
    "js_imports": lambda t: fl.js_imports(t.files),
    "go_metrics": lambda t: fl.go_metrics(t.files),
    "go_imports": lambda t: fl.go_imports(t.files),
    "python_metrics": lambda t: with_imports(fl.python_metrics(t.files)),
    "python_structures": lambda t: with_imports(fl.python_metrics(t.fixture("fx_python"))),
    "python_metrics_approx": lambda t: fl.python_metrics_approx(t.files),
    "test_files": lambda t: fl.is_test_file(t.files),
    "file_metrics": lambda t: with_imports(fl.file_metrics(t.files)),
    "file_imports": imports,
    # presence and documents
    "repo_has_tests": lambda t: docs.repo_has_tests(t.files, t.repos),
    "repo_has_ci": lambda t: docs.repo_has_ci(t.files, t.repos),
    "config_only_repos": lambda t: docs.is_config_only(t.files, t.repos),
    "forks": lambda t: docs.is_fork(t.repos),
    "doc_presence": lambda t: docs.doc_presence(t.files, t.repos),
    "readme_quality": lambda t: docs.readme_quality(t.files, t.repos),
    "repo_description": lambda t: docs.repo_description(t.files, t.repos),
    # reading, searching, trees
    "read_files": read_files,
    "search_code": lambda t: search.search_code(t.files, "async|range|the on"),
    "indexed_search": lambda t: search_index.search_index(search_index.build_index(t.files, buckets=16), "async|range|the on"),
    "indexed_search_word": lambda t: search_index.search_index(search_index.build_index(t.files, buckets=16), r"\bgem +.rails"),
    "file_tree": lambda t: trees.file_tree(t.files).drop("order"),
    "file_tree_nested": lambda t: trees.file_tree_nested(t.files),
    "key_files": lambda t: rp.key_files(t.files),
    "entry_points": lambda t: rp.entry_points(t.files),
    "code_snippets": lambda t: rp.code_snippets(t.files, max_lines=8),
    "repo_roots": repo_roots,
    "new_repos": lambda t: trees.new_repos(repo_roots(t), t.tracked),
    # rollups
    "repo_rollup": lambda t: rp.repo_rollup(fl.file_metrics(t.files)),
    "test_summary": lambda t: rp.test_summary(fl.is_test_file(t.files)),
    "language_breakdown_loc": lambda t: rp.language_breakdown_loc(fl.line_metrics(t.files)),
    "language_breakdown_files": lambda t: rp.language_breakdown_files(fl.file_language_wide(t.files)),
    "primary_language": lambda t: rp.primary_language(rp.language_breakdown_files(fl.file_language_wide(t.files))),
    "languages_int": lambda t: rp.languages_int(rp.language_breakdown_files(fl.file_language_wide(t.files))),
    "import_counts": lambda t: rp.import_counts(imports(t)),
    "notable_libraries": lambda t: rp.notable_libraries(imports(t)),
    "project_type": lambda t: rp.project_type(t.files, t.repos),
    "architecture_patterns": lambda t: rp.architecture_patterns(t.files),
    # frameworks, endpoints
    "framework_sample": lambda t: rules.framework_sample(t.files).select("repo_id", "path", "part", F.length("content").alias("chars")),
    "frameworks": lambda t: rules.detect_frameworks(t.files),
    "test_frameworks": lambda t: rules.test_frameworks(rules.detect_frameworks(t.files)),
    "api_endpoints": endpoints,
    # manifests
    "requirements_dependencies": lambda t: manifests.requirements_dependencies(t.files),
    "pyproject_dependencies": lambda t: manifests.pyproject_dependencies(t.files),
    "package_json_dependencies": lambda t: manifests.package_json_dependencies(t.files),
    "go_mod_dependencies": lambda t: manifests.go_mod_dependencies(t.files),
    "cargo_dependencies": lambda t: manifests.cargo_dependencies(t.files),
    "gemfile_dependencies": lambda t: manifests.gemfile_dependencies(t.files),
    "dependencies": lambda t: manifests.dependencies(t.files),
    "manifest_frameworks": lambda t: manifests.manifest_frameworks(t.files),
    # commits
    "commit_summary": lambda t: history.commit_summary(t.commits, t.repos),
    "contributor_stats": lambda t: history.contributor_report(t.commits),
    "commit_stats": lambda t: history.commit_stats(t.commits, t.commit_files),
    "commit_detail": lambda t: history.commit_detail(t.commits, t.commit_files, "42".zfill(40)),
    "commits_since": lambda t: history.commits_since(t.commits, instant()).select("repo_id", "sha", "walk_pos"),
    "commits_since_sha": lambda t: history.commits_since(
        t.commits, instant(), days=3650, since_sha=SINCE_SHA
    ).select("repo_id", "sha", "walk_pos"),
    "commits_since_date": lambda t: history.commits_since(
        t.commits, instant(), since_date=instant("2001-03-01")
    ).select("repo_id", "sha", "walk_pos"),
    "numbered_commits": lambda t: number_commits(t.commits).select("repo_id", "sha", "walk_pos"),
    "walked_commits": lambda t: walk_commits(t.fixture("fx_walk")).select("repo_id", "sha", "walk_pos"),
    "commit_batches": lambda t: history.commit_batches(t.commits).select("repo_id", "sha", "batch_num", "total_batches"),
    "commits_with_diffs": lambda t: history.commits_with_diffs(t.commits, t.commit_files, instant(), 200, 730).withColumn(
        "diff", F.md5("diff")
    ),
    "commit_prompt_blocks": lambda t: reports.commit_prompt_blocks(t.commits, t.commit_files, instant()).withColumn(
        "text", F.md5("text")
    ),
    "merged_summaries": merged_summaries,
    "achievements": lambda t: history.achievements(t.commits),
    # text rules
    "corpus_files": lambda t: rules.build_corpus(t.files).select(
        "repo_id", "path", "part", "position", F.length("content").alias("chars")
    ),
    "features": lambda t: rules.detect_features(hits(t)),
    "feature_evidence": lambda t: (lambda h: rules.feature_evidence(h, rules.detect_features(h)))(stored_hits(t)),
    "integrations": lambda t: rules.detect_integrations(hits(t)),
    "integration_evidence": lambda t: (lambda h: rules.integration_evidence(h, rules.detect_integrations(h)))(stored_hits(t)),
    "scale_indicators": lambda t: rules.scale_indicators(hits(t)),
    "domains": lambda t: rules.detect_domain(hits(t), t.repos),
    "skills": lambda t: (lambda h: rules.skills(rules.detect_features(h), rules.detect_integrations(h)))(stored_hits(t)),
    "table_rule_integrations": table_rule_integrations,
    "table_rule_features": table_rule_features,
    # assembly and reports
    "repo_analysis": repo_analysis,
    "repo_info": info_row,
    "discover_repos": lambda t: ri.discover_repos(info(t)).select("path", "commit_count"),
    "portfolio_languages": lambda t: ri.portfolio_languages(info(t)),
    "portfolio_rollup": lambda t: ri.portfolio_rollup(info(t)),
    "portfolio_header": lambda t: ri.portfolio_header(info(t)),
    "highlights": highlight_rows,
    "summary_context": lambda t: hl.highlights(t.files, t.commits, t.repos).select("repo_id", "summary_context"),
    "resume_bullets": lambda t: hl.resume_bullets(hl.highlights(t.files, t.commits, t.repos)),
    "metadata_header": lambda t: reports.metadata_header(info(t)),
    "offline_profile": lambda t: reports.offline_profile(
        info(t), analysis.analyze(t.files, t.repos), hl.highlights(t.files, t.commits, t.repos)
    ),
    "report_json": lambda t: sinks.report_json(
        rp.repo_rollup(fl.file_metrics(t.files)).select("repo_id", "total_files", "total_lines", "code_lines", "comment_lines"),
        "repo_id",
    ),
    # scalar functions
    "commit_ages": commit_ages,
    "file_sizes": file_sizes,
    "repo_hashes": lambda t: state.repo_fingerprints(t.commits, t.repos),
    "content_hashes": lambda t: t.files.select("repo_id", "path", formats.content_hash(F.col("content")).alias("hash")),
    "remote_names": lambda t: t.repos.select("repo_id", formats.clean_remote_url(F.col("remote_url")).alias("remote")),
    "commit_labels": commit_labels,
    "short_documents": lambda t: t.files.select("repo_id", "path", formats.ellipsize(F.col("content")).alias("short")),
    "story_dates": story_dates,
    "domain_titles": lambda t: rules.detect_domain(hits(t), t.repos).select(
        "repo_id", formats.domain_title(F.col("domain")).alias("title")
    ),
    # profiles, stories, state
    "list_profiles": listed_profiles,
    "latest_profile": lambda t: state.latest_profile(t.profiles),
    "status_summary": lambda t: state.status_summary(listed_profiles(t)),
    "profiles_to_push": lambda t: state.profiles_to_push(listed_profiles(t)),
    "push_summary": push_summary,
    "saved_names": saved_names,
    "committed_profiles": committed_profiles,
    "stories_page": stories_page,
    "story_cards": lambda t: state.story_cards(t.stories),
    "changed_repos": lambda t: state.changed_repos(state.repo_fingerprints(t.commits, t.repos), stored_state(t)),
    "changed_files": changed_files,
    "next_state": lambda t: state.next_state(state.repo_fingerprints(t.commits, t.repos), stored_state(t)),
    "tracked_status": lambda t: state.tracked_status(t.tracked, t.repos),
    "sync_plan": lambda t: state.sync_plan(t.tracked, t.repos, t.commits),
    "sync_summary": lambda t: state.sync_summary(state.sync_plan(t.tracked, t.repos, t.commits)),
    "streamed_contributors": streamed_contributors,
}
