"""Dependencies and frameworks from root manifests.

A manifest is one row; its lines become rows, and sections are found by carrying the last section
event forward over the lines of that one file.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from codelode import lexicons as lx
from codelode.functions import text
from codelode.functions.paths import lookup

# Manifest to ecosystem, in report order.
ECOSYSTEMS = {
    "requirements.txt": "python", "pyproject.toml": "python", "package.json": "nodejs", "go.mod": "go",
    "Cargo.toml": "rust", "Gemfile": "ruby",
}


def _manifest(files: DataFrame, name: str) -> DataFrame:
    return files.filter(F.col("path") == name).select("repo_id", "content")


def _line_rows(files: DataFrame, name: str, stripped: bool = True) -> DataFrame:
    rows = _manifest(files, name).select("repo_id", F.posexplode(text.all_lines(F.col("content"))).alias("pos", "line"))
    return rows.withColumn("line", text.strip_inline(F.col("line"))) if stripped else rows


def _numbered(rows: DataFrame, path: str, name: Column, pos: Column = None) -> DataFrame:
    pos = F.col("pos") if pos is None else pos
    return rows.select("repo_id", F.lit(path).alias("path"), pos.cast("int").alias("pos"), name.alias("name"))


def _section(event: Column) -> Column:
    """State after each line: the last opening (1) or closing (0) event so far, 0 before any."""
    window = Window.partitionBy("repo_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(event, ignorenulls=True).over(window), F.lit(0))


def requirements_dependencies(files: DataFrame) -> DataFrame:
    line = F.col("line")
    name = F.lower(F.regexp_extract(line, "^([a-zA-Z0-9_-]+)", 1))
    rows = _line_rows(files, "requirements.txt").filter(~line.startswith("#") & ~line.startswith("-"))
    return _numbered(rows, "requirements.txt", name).filter(F.col("name") != "")


def pyproject_dependencies(files: DataFrame) -> DataFrame:
    line = F.col("line")
    opens = line.contains("dependencies") & line.contains("=")
    closes = text.strip_inline(line).startswith("]")
    # the window runs over the lines of one root file per repository
    rows = (
        _line_rows(files, "pyproject.toml", stripped=False)
        .withColumn("opens", opens)
        .withColumn("inside", _section(F.when(opens, 1).when(closes, 0)))
        .filter((F.col("inside") == 1) & ~F.col("opens"))
    )
    name = F.lower(F.regexp_extract(line, '"([a-zA-Z0-9_-]+)', 1))
    return _numbered(rows, "pyproject.toml", name).filter(F.col("name") != "")


NODE_SECTIONS = ("dependencies", "devDependencies")


def _node_names(content: Column) -> list[Column]:
    """Keys of each dependency section of a package file, empty where malformed or absent.

    A present section that is no object ends the reading, as an error would.
    """
    json = F.from_json(content, ", ".join(f"{s} map<string,string>" for s in NODE_SECTIONS))
    whole = text.strip(content).endswith("}")
    present = F.coalesce(F.json_object_keys(content), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    found, sound = [], whole
    for section in NODE_SECTIONS:
        sound = sound & (json[section].isNotNull() | ~F.array_contains(present, section))
        found.append(F.when(sound & json[section].isNotNull(), F.map_keys(json[section])).otherwise(none))
    return found


def package_json_dependencies(files: DataFrame) -> DataFrame:
    """Keys of dependencies, then of devDependencies; nothing from malformed files."""
    rows = _manifest(files, "package.json").select(
        "repo_id", F.posexplode(F.concat(*_node_names(F.col("content")))).alias("pos", "key")
    )
    return _numbered(rows, "package.json", F.col("key"))


def go_mod_dependencies(files: DataFrame) -> DataFrame:
    line = F.col("line")
    tokens = F.filter(F.split(line, f"[{text.SPACE}]+"), lambda t: t != "")
    opens = line.startswith("require (")
    rows = (
        _line_rows(files, "go.mod")
        .withColumn("opens", opens)
        .withColumn("inside", _section(F.when(opens, 1).when(line == ")", 0)))
    )
    name = F.when(F.col("inside") == 1, F.get(tokens, F.lit(0))).when(
        line.startswith("require "), F.get(tokens, F.lit(1))
    )
    return _numbered(rows.filter(~F.col("opens")), "go.mod", name).filter(F.col("name").isNotNull())


def cargo_dependencies(files: DataFrame) -> DataFrame:
    line = F.col("line")
    opens = line.isin("[dependencies]", "[dev-dependencies]")
    rows = _line_rows(files, "Cargo.toml").withColumn(
        "inside", _section(F.when(opens, 1).when(line.startswith("["), 0))
    )
    name = text.strip_inline(F.substring_index(line, "=", 1))
    rows = rows.filter((F.col("inside") == 1) & ~line.startswith("[") & line.contains("="))
    return _numbered(rows, "Cargo.toml", name).filter((F.col("name") != "") & ~F.col("name").startswith("#"))


def gemfile_dependencies(files: DataFrame) -> DataFrame:
    line = F.col("line")
    rows = _line_rows(files, "Gemfile").filter(line.startswith("gem "))
    name = F.regexp_extract(line, "gem ['\"]([^'\"]+)['\"]", 1)
    return _numbered(rows, "Gemfile", name).filter(F.col("name") != "")


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """Every manifest's dependencies: (repo_id, path, pos, name)."""
    found = requirements_dependencies(files)
    for read in (
        pyproject_dependencies, package_json_dependencies, go_mod_dependencies, cargo_dependencies, gemfile_dependencies,
    ):
        found = found.unionByName(read(files))
    return found


def dependencies(files: DataFrame) -> DataFrame:
    """Dependency occurrences per ecosystem: (repo_id, ecosystem, name, n).

    Python names count once where a pyproject file names any dependency; all other lists keep
    repeated names, so ``n`` is how often a name is listed.
    """
    found = manifest_dependencies(files).withColumn("ecosystem", lookup(F.col("path"), ECOSYSTEMS))
    counted = found.groupBy("repo_id", "ecosystem", "name").agg(F.count("*").alias("n"))
    merged = found.filter(F.col("path") == "pyproject.toml").select("repo_id", F.lit("python").alias("ecosystem")).distinct()
    return counted.join(merged.withColumn("merged", F.lit(True)), ["repo_id", "ecosystem"], "left").select(
        "repo_id", "ecosystem", "name", F.when(F.col("merged"), F.lit(1)).otherwise(F.col("n")).cast("bigint").alias("n")
    )


def manifest_frameworks(files: DataFrame) -> DataFrame:
    """Frameworks named in manifests, in discovery order: (repo_id, position, framework).

    Repositories without any have no row.
    """
    low = F.lower("content")
    manifests = files.filter(
        F.col("path").isin(*lx.PYTHON_MANIFESTS, "package.json", "Cargo.toml", "go.mod")
    )
    path = F.col("path")

    def named(table, start):
        return [
            F.when(F.contains(low, F.lit(key)), F.struct(F.lit(start + i).alias("at"), F.lit(name).alias("framework")))
            for i, (key, name) in enumerate(table.items())
        ]

    deps = F.concat(*_node_names(F.col("content")))
    exact = [
        F.when(F.array_contains(deps, key), F.struct(F.lit(400 + i).alias("at"), F.lit(name).alias("framework")))
        for i, (key, name) in enumerate(lx.NODE_MANIFEST_FRAMEWORKS.items())
    ]
    hit = None
    for i, manifest in enumerate(lx.PYTHON_MANIFESTS):
        found = F.array(*named(lx.PYTHON_MANIFEST_FRAMEWORKS, 100 * i))
        hit = F.when(path == manifest, found) if hit is None else hit.when(path == manifest, found)
    hit = (
        hit.when(path == "package.json", F.array(*exact))
        .when(path == "Cargo.toml", F.array(*named(lx.RUST_MANIFEST_FRAMEWORKS, 500)))
        .when(path == "go.mod", F.array(*named(lx.GO_MANIFEST_FRAMEWORKS, 600)))
    )
    return (
        manifests.select("repo_id", F.inline(F.filter(hit, lambda s: s.isNotNull())))
        .groupBy("repo_id", "framework")
        .agg(F.min("at").alias("position"))
        .select("repo_id", "position", "framework")
    )
