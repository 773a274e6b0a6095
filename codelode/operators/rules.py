"""Rule lexicons matched against file texts in one scan.

A lexicon is ``{rule: [pattern, ...]}``. All patterns of all lexicons are looked for together in one
pass over each text, and only non-zero counts leave the scan. The detectors also take a table of rules, with the
rows of ``rule_rows`` and any others, beside the hits that ``rule_tables.rule_table_hits`` finds for it.
"""

from pyspark.sql import DataFrame, functions as F

from codelode import lexicons as lx
from codelode.functions import paths
from codelode.functions.lexicon_scan import lexicon_scan
from codelode.operators.files import exclude_paths
from codelode.operators.ranking import top_k

HIGHLIGHT_LEXICONS = {
    "feature": lx.FEATURES, "integration": lx.INTEGRATIONS, "scale": lx.SCALE, "domain": lx.DOMAINS,
}
MOST_BROADCAST = 100_000  # patterns of a lexicon that is broadcast


def rule_rows(spark, lexicons=HIGHLIGHT_LEXICONS) -> DataFrame:
    """The lexicons as a table; a few hundred rows by construction."""
    rows = [
        (kind, i, rule, j, pattern)
        for kind, lexicon in lexicons.items()
        for i, (rule, patterns) in enumerate(lexicon.items())
        for j, pattern in enumerate(patterns)
    ]
    return spark.createDataFrame(rows, "kind string, rule_pos int, rule string, pattern_pos int, pattern string")


def build_corpus(files: DataFrame, max_files: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Texts that describe a repository: root configuration files, then source files.

    One row per file, ordered by (part, position). Whole texts of all files by default; the two
    limits keep the first files in file order and the first characters of each.
    """
    config = files.filter(F.col("path").isin(lx.CONFIG_FILES)).select(
        "repo_id", "path", F.lit(0).alias("part"),
        F.array_position(F.array(*map(F.lit, lx.CONFIG_FILES)), F.col("path")).cast("int").alias("position"), "content",
    )
    source = exclude_paths(files.filter(paths.lower_suffix(F.col("path")).isin(lx.CORPUS_SUFFIXES)), lx.CORPUS_SKIP)
    body = F.col("content") if max_chars is None else F.substring("content", 1, max_chars)
    source = source.select("repo_id", "path", F.lit(1).alias("part"), body.alias("content"))
    if max_files is None:
        source = source.withColumn("position", F.lit(None).cast("int"))
    else:
        source = top_k(source, ["repo_id"], [paths.parts(F.col("path"))], max_files, "position")
    return config.unionByName(source)


def framework_sample(files: DataFrame, n: int | None = None) -> DataFrame:
    """Texts searched for frameworks: py, js, ts, tsx files in that order, and root package files."""
    suffix = paths.suffix(F.col("path"))
    rank = F.array_position(F.array(*map(F.lit, lx.FRAMEWORK_SUFFIXES)), suffix).cast("int")
    source = files.filter(suffix.isin(lx.FRAMEWORK_SUFFIXES)).select("repo_id", "path", rank.alias("part"), "content")
    if n is not None:
        source = top_k(source, ["repo_id"], [F.col("part"), paths.parts(F.col("path"))], n, "__n").drop("__n")
    package = files.filter(F.col("path").isin(lx.PACKAGE_FILES)).select(
        "repo_id", "path", F.lit(len(lx.FRAMEWORK_SUFFIXES) + 1).alias("part"), "content"
    )
    return source.unionByName(package)


def in_scope(files: DataFrame) -> DataFrame:
    """(repo_id, path, corpus, evidence, content) of the files whose texts rules are matched with."""
    path = F.col("path")
    is_source = paths.lower_suffix(path).isin(lx.CORPUS_SUFFIXES) & ~paths.has_part(path, lx.CORPUS_SKIP)
    return files.select(
        "repo_id", "path",
        (path.isin(lx.CONFIG_FILES) | is_source).alias("corpus"),
        (~paths.has_part(path, lx.SEARCH_SKIP)).alias("evidence"),
        "content",
    ).filter("corpus or evidence")


def file_rule_hits(files: DataFrame, lexicons=HIGHLIGHT_LEXICONS) -> DataFrame:
    """Matches per (file, pattern): one scan for all lexicons, zero counts left out.

    ``in_corpus`` rows count matches on lowercase text and describe the repository; ``in_evidence``
    rows name files that match when case is ignored. A pattern of several rules is looked for once.
    """
    scope = in_scope(files)
    scan = lexicon_scan(p for lexicon in lexicons.values() for ps in lexicon.values() for p in ps)
    found = scope.select("repo_id", "path", "corpus", "evidence", scan("content").alias("found"))
    return (
        found.select("repo_id", "path", "corpus", "evidence", F.inline("found"))
        .select(
            "repo_id", "path", "pattern", "n",
            (F.col("corpus") & (F.col("n") > 0)).alias("in_corpus"),
            (F.col("evidence") & F.col("any_case")).alias("in_evidence"),
        )
        .filter("in_corpus or in_evidence")
    )


def pattern_totals(hits: DataFrame) -> DataFrame:
    """Corpus matches per (repository, pattern)."""
    return hits.filter("in_corpus").groupBy("repo_id", "pattern").agg(F.sum("n").cast("bigint").alias("hits"))


def pattern_evidence(hits: DataFrame, max_files: int = 10) -> DataFrame:
    """First files per (repository, pattern) in file order."""
    seen = hits.filter("in_evidence").select("repo_id", "pattern", "path")
    return top_k(seen, ["repo_id", "pattern"], [paths.parts(F.col("path"))], max_files, "file_pos")


def rules_of(hits: DataFrame, kind: str, lexicons=HIGHLIGHT_LEXICONS) -> DataFrame:
    """(rule_pos, rule, pattern_pos, pattern) of one kind; of a table of rules, the planner decides how it is joined."""
    if isinstance(lexicons, DataFrame):
        return lexicons.filter(F.col("kind") == kind).select("rule_pos", "rule", "pattern_pos", "pattern")
    rows = rule_rows(hits.sparkSession, {kind: lexicons[kind]}).drop("kind")
    patterns = sum(map(len, lexicons[kind].values()))
    return F.broadcast(rows) if patterns <= MOST_BROADCAST else rows


def rule_totals(hits: DataFrame, kind: str, lexicons=HIGHLIGHT_LEXICONS) -> DataFrame:
    """Corpus matches per (repository, rule, pattern) of one kind of rules."""
    return pattern_totals(hits).join(rules_of(hits, kind, lexicons), "pattern")


def detect_features(hits: DataFrame, min_hits: int = 3, k: int = 10, lexicons=HIGHLIGHT_LEXICONS) -> DataFrame:
    """Features with enough matches, best first; one without a title of its own is titled by its name."""
    scored = (
        rule_totals(hits, "feature", lexicons)
        .groupBy("repo_id", F.col("rule_pos"), F.col("rule").alias("feature"))
        .agg(F.sum("hits").alias("hits"))
        .filter(F.col("hits") >= min_hits)
        .withColumn("confidence", F.least(F.lit(1.0), F.col("hits") / 20.0))
    )
    titles = F.create_map(*[F.lit(x) for key, info in lx.FEATURE_INFO.items() for x in (key, info[0])])
    ranked = top_k(scored, ["repo_id"], [F.desc("confidence"), F.col("rule_pos")], k, "position")
    return ranked.select("repo_id", "position", "feature", F.coalesce(titles[F.col("feature")], F.col("feature")).alias("title"), "hits", "confidence")


def feature_evidence(hits: DataFrame, features: DataFrame, k: int = 5, lexicons=HIGHLIGHT_LEXICONS) -> DataFrame:
    """First evidence files of each detected feature: by pattern, then file order, no file twice."""
    rules = rules_of(hits, "feature", lexicons).select(F.col("rule").alias("feature"), "pattern", "pattern_pos")
    counted = pattern_totals(hits).select("repo_id", "pattern")
    candidates = (
        pattern_evidence(hits)
        .join(counted, ["repo_id", "pattern"], "left_semi")
        .join(rules, "pattern")
        .join(features.select("repo_id", "feature"), ["repo_id", "feature"], "left_semi")
        .groupBy("repo_id", "feature", "path")
        .agg(F.min(F.struct("pattern_pos", "file_pos")).alias("first"))
    )
    return top_k(candidates, ["repo_id", "feature"], [F.col("first")], k, "position").drop("first")


def detect_integrations(hits: DataFrame, lexicons=HIGHLIGHT_LEXICONS) -> DataFrame:
    """Vendors with a corpus match; the first matching pattern names the evidence."""
    return (
        rule_totals(hits, "integration", lexicons)
        .groupBy("repo_id", "rule_pos", F.col("rule").alias("integration"))
        .agg(F.min(F.struct("pattern_pos", "pattern")).alias("first"))
        .select("repo_id", "rule_pos", "integration", F.col("first.pattern").alias("pattern"),
                F.lit(0.8).alias("confidence"))
    )


def integration_evidence(hits: DataFrame, integrations: DataFrame, k: int = 3) -> DataFrame:
    return (
        integrations.select("repo_id", "integration", "pattern")
        .join(pattern_evidence(hits, k), ["repo_id", "pattern"])
        .select("repo_id", "integration", F.col("file_pos").alias("position"), "path")
    )


def scale_indicators(hits: DataFrame, lexicons=HIGHLIGHT_LEXICONS) -> DataFrame:
    return rule_totals(hits, "scale", lexicons).select("repo_id", "rule_pos", F.col("rule").alias("indicator")).distinct()


def detect_domain(hits: DataFrame, repos: DataFrame, min_hits: int = 5, lexicons=HIGHLIGHT_LEXICONS) -> DataFrame:
    """Domain with most matches (first listed on a tie), '' where none has enough."""
    scores = rule_totals(hits, "domain", lexicons).groupBy("repo_id", "rule_pos", "rule").agg(F.sum("hits").alias("hits"))
    best = scores.groupBy("repo_id").agg(
        F.max(F.struct("hits", (-F.col("rule_pos")).alias("first"), "rule")).alias("best")
    )
    domain = F.when(F.col("best.hits") >= min_hits, F.col("best.rule")).otherwise("")
    return repos.select("repo_id").join(best, "repo_id", "left").select(
        "repo_id", F.coalesce(domain, F.lit("")).alias("domain")
    )


def skills(features: DataFrame, integrations: DataFrame) -> DataFrame:
    """Skills shown by the detected features and integrations, each once."""
    by_feature = F.create_map(*[
        x for key, info in lx.FEATURE_INFO.items() for x in (F.lit(key), F.array(*map(F.lit, info[1])))
    ])
    learned = features.select("repo_id", F.explode(by_feature[F.col("feature")]).alias("skill"))
    return learned.union(integrations.select("repo_id", "integration")).distinct()


# --- frameworks ------------------------------------------------------------------------------------------------------------------


def framework_scan():
    """Column function: text -> matches of the framework patterns."""
    return lexicon_scan(p.lower() for ps in lx.FRAMEWORKS.values() for p in ps)


def in_framework_sample(path):
    return paths.suffix(path).isin(lx.FRAMEWORK_SUFFIXES) | path.isin(lx.PACKAGE_FILES)


def framework_array(found):
    """Names of the frameworks with a pattern among the matches of ``framework_scan``."""
    seen = F.transform(F.filter(found, lambda m: m["any_case"]), lambda m: m["pattern"])
    names = [
        F.when(F.arrays_overlap(seen, F.array(*[F.lit(p.lower()) for p in ps])), F.lit(name))
        for name, ps in lx.FRAMEWORKS.items()
    ]
    return F.when(F.size(found) > 0, F.filter(F.array(*names), lambda name: name.isNotNull()))


def framework_rows(found: DataFrame) -> DataFrame:
    """Distinct frameworks per repository from per-file arrays ``frameworks``."""
    position = F.array_position(F.array(*map(F.lit, lx.FRAMEWORKS)), F.col("framework")).cast("int")
    return (
        found.select("repo_id", F.explode("frameworks").alias("framework"))
        .distinct()
        .withColumn("rule_pos", position - 1)
    )


def detect_frameworks(files: DataFrame, n: int | None = None) -> DataFrame:
    """Frameworks with any pattern in any sampled file, case ignored."""
    sample = framework_sample(files, n).select("repo_id", framework_scan()("content").alias("found"))
    return framework_rows(sample.select("repo_id", framework_array(F.col("found")).alias("frameworks")))


def test_frameworks(frameworks: DataFrame) -> DataFrame:
    return frameworks.filter(F.col("framework").isin(lx.TEST_FRAMEWORKS)).select("repo_id", "framework")
