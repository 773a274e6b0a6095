"""Per-file operators: scans, filters, languages, line and structure metrics.

``files(repo_id, path, content)`` comes in; content leaves the plan as early as it can.
"""

from pyspark.sql import Column, DataFrame, functions as F

from codelode import lexicons as lx
from codelode.functions import paths, text
from codelode.functions.python_source import python_structure


def exclude_paths(files: DataFrame, skip, hidden_dirs: bool = False, ignore_case: bool = False) -> DataFrame:
    """Drop files below (or named like) a skip name; optionally also below hidden directories."""
    if ignore_case:
        kept = files.filter(~paths.has_part(F.lower("path"), [s.lower() for s in skip]))
    else:
        kept = files.filter(~paths.has_part(F.col("path"), skip))
    if hidden_dirs:
        kept = kept.filter(~F.col("path").rlike(r"(^|/)\.[^/]+/"))
    return kept


def collect_source_files(files: DataFrame, suffixes=lx.SOURCE_SUFFIXES, skip=lx.ANALYSIS_SKIP) -> DataFrame:
    return exclude_paths(files.filter(paths.lower_suffix(F.col("path")).isin(suffixes)), skip)


def _language(path: Column) -> Column:
    return F.coalesce(paths.lookup(paths.lower_suffix(path), lx.LANGUAGES), F.lit("Unknown"))


def file_language(files: DataFrame) -> DataFrame:
    return collect_source_files(files).select("repo_id", "path", _language(F.col("path")).alias("language"))


def file_language_wide(files: DataFrame) -> DataFrame:
    """Files of the wider language table; other files are left out."""
    return (
        exclude_paths(files, lx.LANGUAGE_SKIP)
        .select("repo_id", "path", paths.lookup(paths.lower_suffix(F.col("path")), lx.WIDE_LANGUAGES).alias("language"))
        .filter(F.col("language").isNotNull())
    )


def is_comment_line(line: Column, language: Column) -> Column:
    """Does a line begin like a comment of its language?"""
    return _comment_lines(line, language) > 0


def _comment_lines(content: Column, language: Column) -> Column:
    indent = r"(?dm)^[\t\x0b\f\r\x1c-\x1f\x85\p{Z}]*"
    count = F.lit(0)
    for languages, prefixes in lx.COMMENT_PREFIXES.items():
        starts = "|".join(rf"\Q{p}\E" for p in prefixes)
        found = F.regexp_count(content, F.lit(f"{indent}(?:{starts})"))
        count = F.when(language.isin(*languages), found).otherwise(count)
    return count


def _with_line_counts(df: DataFrame) -> DataFrame:
    """Line counts without splitting: a non-blank line is one match from its first visible character on."""
    content = F.col("content")
    return (
        df.withColumn("lines_total", text.line_count(content))
        .withColumn("__visible", F.regexp_count(content, F.lit(rf"[^{text.SPACE}][^\n]*")))
        .withColumn("lines_comment", _comment_lines(content, F.col("language")))
        .withColumn("lines_blank", F.col("lines_total") - F.col("__visible"))
        .withColumn("lines_code", F.col("__visible") - F.col("lines_comment"))
        .drop("__visible")
    )


def line_metrics(files: DataFrame) -> DataFrame:
    source = collect_source_files(files).withColumn("language", _language(F.col("path")))
    return _with_line_counts(source).select(
        "repo_id", "path", "language", "lines_total", "lines_code", "lines_comment", "lines_blank"
    )


def _js_import_array(content: Column) -> Column:
    found = [F.regexp_extract_all(content, F.lit(text.java_regex(p)), F.lit(1)) for p in lx.JS_IMPORT_PATTERNS]
    names = F.transform(
        F.concat(*found), lambda m: F.replace(F.substring_index(m, "/", 1), F.lit("@"), F.lit(""))
    )
    return F.filter(names, lambda n: (n != "") & ~n.startswith("."))


def _go_import_array(content: Column) -> Column:
    block = F.regexp_extract(content, text.java_regex(lx.GO_IMPORT_BLOCK_PATTERN), 1)
    quoted = F.transform(text.lines(block), lambda line: F.regexp_extract(line, '"([^"]+)"', 1))
    single = F.regexp_extract_all(content, F.lit(text.java_regex(lx.GO_IMPORT_PATTERN)), F.lit(1))
    modules = F.concat(F.filter(quoted, lambda q: q != ""), single)
    return F.transform(modules, lambda m: F.substring_index(m, "/", -1))


def _structure(content: Column, kind: str) -> dict[str, Column]:
    if kind == "js":
        return {
            "functions": text.total_matches(content, lx.JS_FUNCTION_PATTERNS),
            "classes": text.match_count(content, lx.JS_CLASS_PATTERN),
            "complexity": text.total_matches(content, lx.JS_BRANCH_PATTERNS),
            "imports": _js_import_array(content),
        }
    return {
        "functions": text.match_count(content, lx.GO_FUNCTION_PATTERN),
        "classes": text.match_count(content, lx.GO_STRUCT_PATTERN),
        "complexity": text.total_matches(content, lx.GO_BRANCH_PATTERNS),
        "imports": _go_import_array(content),
    }


JS_LANGUAGES = ("JavaScript", "TypeScript")


def _source_of(files: DataFrame, *languages) -> DataFrame:
    return collect_source_files(files).filter(_language(F.col("path")).isin(*languages))


def _structure_rows(files: DataFrame, kind: str) -> DataFrame:
    found = _structure(F.col("content"), kind)
    return files.select("repo_id", "path", *[found[c].alias(c) for c in ("functions", "classes", "complexity")])


def js_metrics(files: DataFrame) -> DataFrame:
    return _structure_rows(_source_of(files, *JS_LANGUAGES), "js")


def go_metrics(files: DataFrame) -> DataFrame:
    return _structure_rows(_source_of(files, "Go"), "go")


def _import_rows(df: DataFrame, imports: Column) -> DataFrame:
    return df.select("repo_id", "path", F.posexplode(imports).alias("import_pos", "name"))


def js_imports(files: DataFrame) -> DataFrame:
    return _import_rows(_source_of(files, *JS_LANGUAGES), _js_import_array(F.col("content")))


def go_imports(files: DataFrame) -> DataFrame:
    return _import_rows(_source_of(files, "Go"), _go_import_array(F.col("content")))


def python_metrics(files: DataFrame) -> DataFrame:
    """Structure of Python files from the syntax tree; zeros where the text does not parse."""
    found = _source_of(files, "Python").select("repo_id", "path", python_structure("content").alias("s"))
    return found.select("repo_id", "path", "s.*")


def python_metrics_approx(files: DataFrame) -> DataFrame:
    """Native approximation of ``python_metrics`` from line beginnings; no Python workers."""
    content = F.col("content")

    def at_line_start(words):
        return F.regexp_count(content, F.lit(rf"(?dm)^[ \t]*(?:{words})\b"))

    return _source_of(files, "Python").select(
        "repo_id", "path",
        at_line_start("(?:async[ \\t]+)?def").alias("functions"),
        at_line_start("class").alias("classes"),
        at_line_start("if|elif|for|while|except|with").alias("complexity"),
    )


def is_test(path: Column, content: Column) -> Column:
    low = F.lower(path)
    in_path = F.lit(False)
    for piece in lx.TEST_PATH_PARTS:
        in_path = in_path | F.contains(low, F.lit(piece))
    return F.when(in_path, True).otherwise(text.any_match(content, lx.TEST_CONTENT_PATTERNS))


def is_test_file(files: DataFrame) -> DataFrame:
    return collect_source_files(files).select(
        "repo_id", "path", is_test(F.col("path"), F.col("content")).alias("has_tests")
    )


_COUNTS = ["lines_total", "lines_code", "lines_comment", "lines_blank"]
_STRUCTURE = ["functions", "classes", "complexity", "imports"]


def with_source_metrics(scanned: DataFrame) -> DataFrame:
    """Replace the text of each row by the metrics of its source file; zeros where not ``is_source``.

    Other columns stay. Only Python texts travel to Python workers; everything else is native.
    """
    kept = [c for c in scanned.columns if c != "content"]
    content, language = F.col("content"), F.col("language")
    source = scanned.withColumn("language", F.when(F.col("is_source"), _language(F.col("path"))))
    measured = source.withColumn("content", F.when(F.col("is_source"), content))
    js, go = _structure(content, "js"), _structure(content, "go")
    none = {"imports": F.array().cast("array<string>")}
    native = _with_line_counts(measured).select(
        *kept, "language", *_COUNTS,
        is_test(F.col("path"), content).alias("has_tests"),
        *[
            F.when(language.isin(*JS_LANGUAGES), js[c]).when(language == "Go", go[c])
            .otherwise(none.get(c, F.lit(0))).alias(f"__{c}")
            for c in _STRUCTURE
        ],
        F.when(language == "Python", content).alias("__python"),
    )
    parsed = native.withColumn("__s", python_structure("__python")).drop("__python")
    python = language == "Python"
    return parsed.select(
        *kept, "language", *_COUNTS,
        *[F.when(python, F.col(f"__s.{c}")).otherwise(F.col(f"__{c}")).alias(c) for c in _STRUCTURE],
        F.col("__s.avg_function_length").alias("avg_function_length"),
        "has_tests",
        F.col("__s.has_docstrings").alias("has_docstrings"),
    )


def file_metrics(files: DataFrame) -> DataFrame:
    """All metrics of every source file in one pass over the texts."""
    source = collect_source_files(files).select("repo_id", "path", "content", F.lit(True).alias("is_source"))
    return with_source_metrics(source).drop("is_source")


def file_imports(metrics: DataFrame) -> DataFrame:
    """One row per import occurrence, in file and then source order."""
    return metrics.select("repo_id", "path", F.posexplode("imports").alias("import_pos", "name"))
