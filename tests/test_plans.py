"""What the physical plans have to look like on stored tables."""

import re

import pytest
from pyspark.sql import functions as F

from codelode.operators import files as fl, history, manifests, repo as rp, repo_docs as docs, rules, search, state, trees
from codelode.plans import analysis, repo_info
from tests.conftest import COMMITS, FILES


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lake"))
    spark.createDataFrame([(i % 3, f"src/m{i}.py", "import x\n") for i in range(30)], FILES).write.parquet(f"{folder}/files")
    spark.createDataFrame([], COMMITS).write.parquet(f"{folder}/commits")
    spark.createDataFrame([(i, f"r{i}", f"/r{i}") for i in range(3)], "repo_id int, name string, path string").write.parquet(f"{folder}/repos")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in ("files", "commits", "repos")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return re.findall(r"ReadSchema: struct<([^>]*)>", df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    ))


PATH_ONLY = {
    "languages": lambda t: rp.language_breakdown_files(fl.file_language_wide(t["files"])),
    "tests": lambda t: docs.repo_has_tests(t["files"], t["repos"]),
    "docs": lambda t: docs.doc_presence(t["files"], t["repos"]),
    "project_type": lambda t: rp.project_type(t["files"], t["repos"]),
    "architecture": lambda t: rp.architecture_patterns(t["files"]),
    "key_files": lambda t: rp.key_files(t["files"]),
    "entry_points": lambda t: rp.entry_points(t["files"]),
    "tree": lambda t: trees.file_tree(t["files"]),
    "config_only": lambda t: docs.is_config_only(t["files"], t["repos"]),
}


@pytest.mark.parametrize("name", PATH_ONLY)
def test_path_operators_do_not_read_content(lake, name):
    assert all("content" not in columns for columns in scans(PATH_ONLY[name](lake)))


TOP_K = {
    "key_files": lambda t: rp.key_files(t["files"]),
    "entry_points": lambda t: rp.entry_points(t["files"]),
    "import_counts": lambda t: rp.import_counts(fl.file_imports(fl.file_metrics(t["files"]))),
    "evidence": lambda t: rules.pattern_evidence(rules.file_rule_hits(t["files"])),
    "search": lambda t: search.search_code(t["files"], "x"),
    "snippets": lambda t: rp.code_snippets(t["files"]),
    "corpus": lambda t: rules.build_corpus(t["files"], max_files=100),
}


@pytest.mark.parametrize("name", TOP_K)
def test_top_k_is_limited_before_the_shuffle(lake, name):
    text = plan(TOP_K[name](lake))
    assert "WindowGroupLimit" in text and "Partial" in text


ALL = {
    **PATH_ONLY, **TOP_K,
    "dependencies": lambda t: manifests.dependencies(t["files"]),
    "facts": lambda t: analysis.file_facts(t["files"]),
    "contributors": lambda t: history.contributor_stats(t["commits"]),
    "since": lambda t: history.commits_since(t["commits"], F.lit("2024-01-01").cast("timestamp_ntz")),
    "fingerprints": lambda t: state.repo_fingerprints(t["commits"], t["repos"]),
    "domain": lambda t: rules.detect_domain(rules.file_rule_hits(t["files"]), t["repos"]),
}


@pytest.mark.parametrize("name", ALL)
def test_no_pairwise_joins(lake, name):
    text = plan(ALL[name](lake))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_manifest_and_readme_filters_reach_the_scan(lake):
    for df in (manifests.requirements_dependencies(lake["files"]), docs.readme_quality(lake["files"], lake["repos"])):
        assert re.search(r"PushedFilters: \[[^\]]*path", plan(df)), plan(df)


def test_line_metrics_need_no_shuffle(lake):
    assert "Exchange" not in plan(fl.line_metrics(lake["files"]))
    assert "Exchange" not in plan(fl.file_metrics(lake["files"]))
    assert "Exchange" not in plan(rules.file_rule_hits(lake["files"]))


def test_files_are_scanned_once_for_all_facts(lake):
    assert plan(analysis.file_facts(lake["files"])).count("FileScan") == 1
    assert plan(rules.file_rule_hits(lake["files"])).count("FileScan") == 1


def test_one_request_leaves_texts_where_they_are(spark, lake):
    asked = spark.createDataFrame([(1, "src/m1.py")], "repo_id int, path string")
    text = plan(search.read_file(lake["files"], asked))
    assert "BroadcastHashJoin" in text
    for line in text.splitlines():
        if " Exchange " in line:
            assert "content" not in line


def test_commit_stats_deals_file_rows_once(spark, lake):
    rows = spark.createDataFrame([], "repo_id int, sha string, file_pos int, path string, insertions int, deletions int")
    text = plan(history.commit_stats(lake["commits"], rows))
    assert text.count("hashpartitioning(repo_id") - text.count("ENSURE_REQUIREMENTS") <= 1


def test_a_portfolio_reads_repository_info_once(lake):
    repos = lake["repos"].withColumns({c: F.lit(None).cast("string") for c in ("remote_url", "user_email", "user_name")})
    info = repo_info.repo_info(lake["files"], lake["commits"], repos, F.lit("2024-01-01").cast("timestamp_ntz"))
    once = plan(info).count("FileScan")
    for made in (repo_info.portfolio_rollup(info), repo_info.portfolio_header(info), repo_info.portfolio_languages(info)):
        assert plan(made).count("FileScan") <= once
    empty = repo_info.portfolio_rollup(info.filter("false")).collect()
    assert [tuple(r) for r in empty] == [(0, "Unknown", "Unknown", "Unknown")]
