"""Reading and searching file texts."""

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode import lexicons as lx
from codelode.functions import paths, text
from codelode.operators.files import exclude_paths
from codelode.operators.ranking import top_k

MAX_FILE_BYTES = 1024 * 1024  # fixed value


def read_file(files: DataFrame, requests: DataFrame, max_lines: int = 500) -> DataFrame:
    """Answer each requested (repo_id, path) with the file's first lines or a reason why not."""
    content, size = F.col("content"), F.col("size")
    total = text.line_count(content)
    shown = files.withColumn("size", F.octet_length("content").cast("bigint"))
    is_text = F.col("is_text") if "is_text" in files.columns else F.lit(True)
    found = shown.select(
        "repo_id", "path", "size", is_text.alias("is_text"),
        F.when(is_text & (size <= MAX_FILE_BYTES), text.head_lines(content, max_lines)).alias("content"),
        total.alias("total"),
    )
    wanted = requests.select("repo_id", "path").distinct()
    # what is asked for is looked up first, so that few requests meet the files without a shuffle of their texts
    found = found.join(wanted, ["repo_id", "path"])
    asked = wanted.select("repo_id").distinct()
    folders = (
        files.select("repo_id", "path").join(asked, "repo_id", "left_semi")
        .select("repo_id", F.explode(paths.ancestors(F.col("path"))).alias("path"))
        .join(wanted, ["repo_id", "path"], "left_semi")
        .distinct()
        .withColumn("is_folder", F.lit(True))
    )
    answered = wanted.join(found, ["repo_id", "path"], "left").join(folders, ["repo_id", "path"], "left")
    error = (
        F.when(F.col("is_folder"), "Not a file")
        .when(size.isNull(), "File not found")
        .when(size > MAX_FILE_BYTES, "File too large")
        .when(~F.col("is_text"), "Binary file")
    )
    fine = error.isNull()
    return answered.select(
        "repo_id", "path", error.alias("error"), F.when(fine, content).alias("content"),
        F.when(fine, F.least("total", F.lit(max_lines))).alias("lines"),
        F.when(fine, F.col("total") > max_lines).alias("truncated"),
        size,
    )


def is_valid(spark: SparkSession, pattern: str, regex: str) -> bool:
    """Whether the pattern is one for Python, and its translation one for the engine that runs it; needs no job."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    try:
        spark._jvm.java.util.regex.Pattern.compile(regex)
    except IllegalArgumentException:
        return False
    return True


def invalid_pattern(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.range(1).select(
        F.lit(None).cast("int").alias("repo_id"), F.lit(None).cast("string").alias("path"),
        F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("content"),
        F.lit(f"Invalid regex pattern: {pattern}").alias("error"),
    )


def searchable(files: DataFrame) -> DataFrame:
    """The files that a search looks into."""
    if "is_text" in files.columns:
        files = files.filter("is_text")
    return exclude_paths(files, lx.SEARCH_SKIP).filter(~paths.suffix(F.col("path")).isin(lx.BINARY_SUFFIXES))


def line_hits(texts: DataFrame, keys: list[str], pattern: str, regex: str) -> DataFrame:
    """(keys, line, content) of the lines that match; lines are filtered inside their text's row, so only they become rows."""
    numbered = F.transform(
        text.lines(F.col("content")), lambda line, i: F.struct((i + 1).alias("line"), line.alias("content"))
    )
    if not re.search(r"\\[AZz]|\^|\$|\(\?", pattern):
        # without anchors a match in a line is a match in the file: files without one stay whole
        texts = texts.filter(F.col("content").rlike(regex))
    hits = texts.select(*keys, F.inline(F.filter(numbered, lambda n: n["content"].rlike(regex))))
    return hits.withColumn("content", F.substring(text.strip_inline(F.col("content")), 1, 200))


def search_code(files: DataFrame, pattern: str, max_results: int = 50) -> DataFrame:
    """Lines that match a pattern without regard to case, the first ones per repository.

    Every call reads every text; ``search_index`` answers repeated searches of the same files from an index.
    """
    regex = text.java_regex(pattern, "diu")
    if not is_valid(files.sparkSession, pattern, regex):
        return invalid_pattern(files.sparkSession, pattern)
    shown = line_hits(searchable(files), ["repo_id", "path"], pattern, regex)
    first = top_k(shown, ["repo_id"], [paths.parts(F.col("path")), F.col("line")], max_results, "position")
    return first.select("repo_id", "path", "line", "content", F.lit(None).cast("string").alias("error"))
