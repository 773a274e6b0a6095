"""Whole-repository analysis: one content scan into a narrow fact table, then rollups of it."""

from pyspark.sql import Column, DataFrame, functions as F

from codelode import lexicons as lx
from codelode.functions import paths
from codelode.operators import files as fl, repo as rp, repo_docs as docs, rules
from codelode.operators.ranking import side_by_side
from codelode.sources.shared import write_shared


def _uses(path: Column) -> tuple[Column, Column, Column]:
    """Whether the file counts as source, is searched for frameworks, and may declare routes."""
    is_source = paths.lower_suffix(path).isin(lx.SOURCE_SUFFIXES) & ~paths.has_part(path, lx.ANALYSIS_SKIP)
    return is_source, rules.in_framework_sample(path), paths.suffix(path).isin(lx.ENDPOINT_SUFFIXES)


def needs_text(path: Column) -> Column:
    """Whether ``file_facts`` looks into the file at all."""
    is_source, sampled, routed = _uses(path)
    return is_source | sampled | routed


def file_facts(files: DataFrame) -> DataFrame:
    """What the rollups need of each file, without its text.

    One scan gives source metrics, framework names and route declarations together; files that
    contribute none of them are left out.
    """
    is_source, sampled, routed = _uses(F.col("path"))
    scanned = files.filter(needs_text(F.col("path"))).select(
        "repo_id", "path", "content", is_source.alias("is_source"),
        rules.framework_scan()(F.when(sampled, F.col("content"))).alias("found"),
    )
    extras = scanned.select(
        "repo_id", "path", "content", "is_source",
        rules.framework_array(F.col("found")).alias("frameworks"),
        F.when(routed, rp.endpoint_array(F.col("content"))).alias("endpoints"),
    )
    return fl.with_source_metrics(extras)


def framework_facts(facts: DataFrame) -> DataFrame:
    return rules.framework_rows(facts.filter(F.col("frameworks").isNotNull()))


def endpoint_facts(facts: DataFrame) -> DataFrame:
    suffix_pos = F.array_position(F.array(*map(F.lit, lx.ENDPOINT_SUFFIXES)), paths.suffix(F.col("path"))).cast("int")
    return facts.filter(F.size("endpoints") > 0).select("repo_id", suffix_pos.alias("suffix_pos"), "path", F.inline("endpoints"))


def analyze(files: DataFrame, repos: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """One row per repository with all sections of the analysis.

    Every branch is reduced to at most a few dozen rows per repository before the joins, so lists
    and maps stay small however large the repository is.
    """
    facts = write_shared(file_facts(files), "file-facts") if facts is None else facts
    paths_only = write_shared(files.select("repo_id", "path"), "file-paths")  # read by many sections
    metrics = facts.filter("is_source")
    imports = fl.file_imports(metrics)
    frameworks, endpoints = framework_facts(facts), endpoint_facts(facts)

    def listed(df, order, value, name):
        pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
        return df.groupBy("repo_id").agg(F.transform(pairs, lambda p: p["v"]).alias(name))

    sections = [
        rp.repo_rollup(metrics).drop("avg_function_length"),
        rp.test_summary(metrics),
        listed(rp.language_breakdown_loc(metrics), "position", F.struct("language", "pct"), "languages"),
        listed(frameworks, "rule_pos", F.col("framework"), "frameworks"),
        listed(rp.notable_libraries(imports), "position", F.col("library"), "notable_libraries"),
        rp.project_type(paths_only, repos),
        listed(rp.architecture_patterns(paths_only), "rule_pos", F.col("architecture"), "architecture"),
        docs.doc_presence(paths_only, repos),
        docs.readme_quality(files, repos),
        listed(
            rp.api_endpoints(endpoints, frameworks, 20), "position",
            F.struct("method", F.col("route").alias("path"), F.col("path").alias("file")), "api_endpoints",
        ),
        listed(rp.key_files(paths_only), "position", F.col("path"), "key_files"),
        listed(rp.entry_points(paths_only), "position", F.col("path"), "entry_points"),
        listed(
            rp.import_counts(imports, 15), "position", F.struct("name", F.col("n").alias("count")), "most_used_imports"
        ),
    ]
    out = side_by_side(repos.select("repo_id"), "repo_id", sections)

    def number(name, kind="bigint"):
        return F.coalesce(name, F.lit(0)).cast(kind).alias(name)

    def rounded(name, digits):
        return F.bround(F.coalesce(name, F.lit(0.0)), digits)

    def items(name, kind="array<string>"):
        return F.coalesce(F.col(name), F.array().cast(kind)).alias(name)

    found = items("frameworks")
    return out.select(
        "repo_id",
        F.struct(
            number("total_files"), number("total_lines"), number("code_lines"), number("comment_lines"), "project_type"
        ).alias("summary"),
        F.map_from_entries(items("languages", "array<struct<language:string,pct:double>>")).alias("languages"),
        found,
        items("notable_libraries"),
        items("architecture"),
        F.struct(
            rounded("avg_file_size", 1).alias("avg_file_size_lines"),
            rounded("avg_complexity", 2).alias("avg_complexity"),
            rounded("docstring_coverage", 1).alias("docstring_coverage_pct"),
        ).alias("quality"),
        F.struct(
            F.coalesce("has_tests", F.lit(False)).alias("has_tests"),
            number("test_files"),
            rounded("test_ratio", 2).alias("test_ratio"),
            F.array_intersect(F.array(*map(F.lit, lx.TEST_FRAMEWORKS)), found).alias("test_frameworks"),
        ).alias("testing"),
        F.struct("has_readme", "readme_quality", "has_docs_folder", "has_changelog", "has_contributing").alias(
            "documentation"
        ),
        items("api_endpoints", "array<struct<method:string,path:string,file:string>>"),
        items("key_files"),
        items("entry_points"),
        items("most_used_imports", "array<struct<name:string,count:bigint>>"),
    )
