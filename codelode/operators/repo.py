"""Per-repository rollups of file metrics, imports, paths and endpoints."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from codelode import lexicons as lx
from codelode.functions import paths, text
from codelode.operators.ranking import spread_join, top_k


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def repo_rollup(metrics: DataFrame) -> DataFrame:
    """Totals and averages per repository, unrounded."""
    return metrics.groupBy("repo_id").agg(
        F.count("*").alias("total_files"),
        F.sum("lines_total").cast("bigint").alias("total_lines"),
        F.sum("lines_code").cast("bigint").alias("code_lines"),
        F.sum("lines_comment").cast("bigint").alias("comment_lines"),
        _ratio(F.sum("lines_code"), F.count("*")).alias("avg_file_size"),
        _ratio(F.sum("complexity"), F.sum("functions")).alias("avg_complexity"),
        (_ratio(F.sum(F.col("has_docstrings").cast("int")), F.count("*")) * 100).alias("docstring_coverage"),
        F.lit(0.0).alias("avg_function_length"),
    )


def test_summary(metrics: DataFrame) -> DataFrame:
    tests = F.sum(F.col("has_tests").cast("int")).cast("bigint")
    return metrics.groupBy("repo_id").agg(
        tests.alias("test_files"),
        (tests > 0).alias("has_tests"),
        _ratio(tests, F.count("*") - tests).alias("test_ratio"),
    )


def _shares(files: DataFrame, weight: Column) -> DataFrame:
    """Rounded percentages of at least one percent, largest first, then as met in file order.

    The windows run over the languages of a repository, a few dozen rows at most.
    """
    weights = files.groupBy("repo_id", "language").agg(
        weight.cast("bigint").alias("weight"), F.min(paths.parts(F.col("path"))).alias("first")
    )
    total = F.sum("weight").over(Window.partitionBy("repo_id"))
    order = Window.partitionBy("repo_id").orderBy(F.desc("weight"), "first")
    return (
        weights.withColumn("total", total)
        .withColumn("position", F.row_number().over(order))
        .filter((F.col("total") > 0) & (F.col("weight") * 100 >= F.col("total")))
        .select(
            "repo_id", "position", "language",
            F.bround(F.col("weight") * 100.0 / F.col("total"), 1).alias("pct"),
        )
    )


def language_breakdown_loc(metrics: DataFrame) -> DataFrame:
    """Share of code lines per known language."""
    return _shares(metrics.filter(F.col("language") != "Unknown"), F.sum("lines_code"))


def language_breakdown_files(wide: DataFrame) -> DataFrame:
    """Share of files per language, from ``file_language_wide``."""
    return _shares(wide, F.count("*"))


def primary_language(breakdown: DataFrame) -> DataFrame:
    """First language of ``language_breakdown_files``."""
    return breakdown.filter(F.col("position") == 1).select("repo_id", F.col("language").alias("primary_language"))


def languages_int(breakdown: DataFrame) -> DataFrame:
    """Shares cut to whole percents."""
    return breakdown.select("repo_id", "position", "language", F.col("pct").cast("int").alias("pct"))


def import_counts(imports: DataFrame, k: int = 20) -> DataFrame:
    """Most used imports; equal counts keep the order of first use."""
    counted = _first_uses(imports)
    ranked = top_k(counted, ["repo_id"], [F.desc("n"), F.col("first")], k, "position")
    return ranked.select("repo_id", "position", "name", "n")


def _first_uses(imports: DataFrame) -> DataFrame:
    order = F.struct(paths.parts(F.col("path")).alias("parts"), F.col("import_pos"))
    return imports.groupBy("repo_id", "name").agg(F.count("*").alias("n"), F.min(order).alias("first"))


def notable_libraries(imports: DataFrame, k: int = 15) -> DataFrame:
    """Well-known libraries inside import names, in order of first import and then of the list."""
    low = F.lower("name")
    libraries = F.filter(
        F.array(*[
            F.when(F.contains(low, F.lit(lib)), F.struct(F.lit(i).alias("lib_pos"), F.lit(lib).alias("library")))
            for i, lib in enumerate(lx.NOTABLE_LIBRARIES)
        ]),
        lambda s: s.isNotNull(),
    )
    found = (
        _first_uses(imports)
        .select("repo_id", "first", F.inline(libraries))
        .groupBy("repo_id", "library")
        .agg(F.min(F.struct("first", "lib_pos")).alias("at"))
    )
    return top_k(found, ["repo_id"], [F.col("at")], k, "position").select("repo_id", "position", "library")


def _indicator_count(path: Column, indicators) -> Column:
    low = F.lower(path)
    hits = [F.contains(low, F.lit(i.lower())).cast("int") for i in indicators]
    return sum(hits[1:], hits[0])


def project_type(files: DataFrame, repos: DataFrame) -> DataFrame:
    """Type whose indicators occur in most paths, directories included; 'unknown' without any."""
    directories = files.select("repo_id", F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    entries = files.select("repo_id", "path").unionByName(directories)
    kinds = list(lx.PROJECT_TYPES)
    scores = entries.groupBy("repo_id").agg(*[
        F.sum(_indicator_count(F.col("path"), lx.PROJECT_TYPES[k])).alias(f"s{i}") for i, k in enumerate(kinds)
    ])
    # greatest (score, -position): the first listed type wins a tie
    best = F.array_max(F.array(*[
        F.struct(F.col(f"s{i}").alias("score"), F.lit(-i).alias("first"), F.lit(k).alias("kind"))
        for i, k in enumerate(kinds)
    ]))
    found = scores.select("repo_id", best.alias("best")).filter(F.col("best.score") > 0)
    return repos.select("repo_id").join(found, "repo_id", "left").select(
        "repo_id", F.coalesce("best.kind", F.lit("unknown")).alias("project_type")
    )


def architecture_patterns(files: DataFrame) -> DataFrame:
    """Architectures with at least half of their directory indicators present."""
    directories = F.transform(
        F.slice(paths.parts(F.lower("path")), 1, F.size(paths.parts(F.col("path"))) - 1), lambda d: F.concat(d, F.lit("/"))
    )
    indicators = [(a, i.lower()) for a, items in lx.ARCHITECTURES.items() for i in items]
    present = files.select("repo_id", directories.alias("dirs")).filter(F.size("dirs") > 0)

    def shows(indicator):
        return F.exists("dirs", lambda d: F.contains(d, F.lit(indicator)))

    flags = present.groupBy("repo_id").agg(*[F.max(shows(i)).alias(f"f{n}") for n, (_, i) in enumerate(indicators)])
    verdicts = []
    for position, (name, items) in enumerate(lx.ARCHITECTURES.items()):
        hits = sum([F.col(f"f{n}").cast("int") for n, (a, _) in enumerate(indicators) if a == name], F.lit(0))
        row = F.struct(F.lit(position).alias("rule_pos"), F.lit(name).alias("architecture"), hits.alias("matched"))
        verdicts.append(F.when(hits * 2 >= len(items), row))
    return flags.select("repo_id", F.inline(F.filter(F.array(*verdicts), lambda v: v.isNotNull())))


# --- endpoints ---------------------------------------------------------------------------------------------------------------------


def _family_routes(content: Column, position: int, family: str, pattern: str) -> Column:
    regex = F.lit(text.java_regex(pattern, "diu"))
    pairs = F.arrays_zip(
        F.regexp_extract_all(content, regex, F.lit(1)).alias("m"), F.regexp_extract_all(content, regex, F.lit(2)).alias("r")
    )
    return F.transform(
        pairs,
        lambda p, n: F.struct(
            F.lit(position).alias("family_pos"), F.lit(family).alias("family"), n.alias("match_pos"),
            F.upper(p["m"]).alias("method"), p["r"].alias("route"),
        ),
    )


def endpoint_array(content: Column) -> Column:
    """Route declarations of one text: (family_pos, family, match_pos, method, route)."""
    families = [_family_routes(content, i, *item) for i, item in enumerate(lx.ENDPOINT_PATTERNS.items())]
    none = F.array().cast(
        "array<struct<family_pos:int,family:string,match_pos:int,method:string,route:string>>"
    )
    # every pattern needs one of these words, with its dot and bracket; most texts have none
    receiver = F.lower(content)
    possible = F.lit(False)
    for word in ("app.", "router.", "blueprint."):
        possible = possible | F.contains(receiver, F.lit(word))
    return F.when(possible, F.concat(*families)).otherwise(none)


def endpoint_rows(files: DataFrame) -> DataFrame:
    """All route declarations of py, js and ts files, gates not yet applied."""
    suffix = paths.suffix(F.col("path"))
    position = F.array_position(F.array(*map(F.lit, lx.ENDPOINT_SUFFIXES)), suffix).cast("int")
    return (
        files.filter(suffix.isin(lx.ENDPOINT_SUFFIXES))
        .select("repo_id", position.alias("suffix_pos"), "path", F.inline(endpoint_array(F.col("content"))))
    )


def api_endpoints(endpoints: DataFrame, frameworks: DataFrame, k: int = 50) -> DataFrame:
    """Distinct (method, route) of the families that detected frameworks switch on, all if none is."""
    gates = [(fw, family) for family, fws in lx.ENDPOINT_GATES.items() for fw in fws]
    gate = F.create_map(*[F.lit(x) for pair in gates for x in pair])
    active = (
        frameworks.filter(F.col("framework").isin([fw for fw, _ in gates]))
        .groupBy("repo_id")
        .agg(F.collect_set(gate[F.col("framework")]).alias("active"))
    )
    gated = spread_join(endpoints, active, "repo_id", ["path", "route"], "left").filter(
        F.col("active").isNull() | F.array_contains("active", F.col("family"))
    )
    order = F.struct("suffix_pos", paths.parts(F.col("path")).alias("parts"), "family_pos", "match_pos", "path")
    first = gated.groupBy("repo_id", "method", "route").agg(F.min(order).alias("first"))
    ranked = top_k(first, ["repo_id"], [F.col("first")], k, "position")
    return ranked.select("repo_id", "position", "method", "route", F.col("first.path").alias("path"))


# --- key files -----------------------------------------------------------------------------------------------------------------------


def _list_position(names, value: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), value).cast("int")


def key_files(files: DataFrame, k: int = 20) -> DataFrame:
    name = paths.basename(F.col("path"))
    found = files.filter(name.isin(lx.KEY_FILES)).select(
        "repo_id", "path", _list_position(lx.KEY_FILES, name).alias("pattern_pos")
    )
    ranked = top_k(found, ["repo_id"], [F.col("pattern_pos"), paths.parts(F.col("path"))], k, "position")
    return ranked.select("repo_id", "position", "path")


def entry_points(files: DataFrame, k: int = 5) -> DataFrame:
    """Entry files at the root or below src/ or cmd/; a file counts once per pattern it fits."""
    path = F.col("path")
    near = ~path.contains("/") | path.startswith("src/") | path.startswith("cmd/")
    tails = F.array_distinct(F.array(F.substring_index(path, "/", -1), F.substring_index(path, "/", -2)))
    fits = files.filter(near).select("repo_id", "path", F.explode(tails).alias("tail")).filter(
        F.col("tail").isin(lx.ENTRY_POINTS)
    )
    placed = fits.select("repo_id", "path", _list_position(lx.ENTRY_POINTS, F.col("tail")).alias("pattern_pos"))
    ranked = top_k(placed, ["repo_id"], [F.col("pattern_pos"), paths.parts(path)], k, "position")
    return ranked.select("repo_id", "position", "path")


def code_snippets(files: DataFrame, max_snippets: int = 5, max_lines: int = 50) -> DataFrame:
    """Openings of the first interesting files, by name list and then file order."""
    name, content = paths.basename(F.col("path")), F.col("content")
    total = text.line_count(content)
    found = files.filter(name.isin(lx.SNIPPET_FILES)).select(
        "repo_id", "path", _list_position(lx.SNIPPET_FILES, name).alias("pattern_pos"),
        text.head_lines(content, max_lines).alias("content"),
        total.alias("total_lines"), (total > max_lines).alias("truncated"),
    )
    ranked = top_k(found, ["repo_id"], [F.col("pattern_pos"), paths.parts(F.col("path"))], max_snippets, "position")
    return ranked.select("repo_id", "position", "path", "content", "total_lines", "truncated")
