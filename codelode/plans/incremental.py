"""Analysis of what changed only: facts of files are kept, and texts are opened for files that are new or different."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode import lexicons as lx
from codelode.plans.analysis import analyze, file_facts, needs_text
from codelode.sources.files import list_files, read_listed
from codelode.sources.shared import write_shared

KEYS = ["repo_id", "path"]
BRANCH = ["repo_id", "branch"]


def branches(listed: DataFrame) -> DataFrame:
    """A digest of each top folder of a repository, and of the files beside them: what it holds, in any order."""
    branch = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise("")
    marked = listed.select("repo_id", branch.alias("branch"), F.xxhash64("path", "stamp").alias("one"), F.xxhash64("stamp", "path", F.lit(1)).alias("two"))
    return marked.groupBy(*BRANCH).agg(F.count("*").alias("n"), F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"))


def changed_files(listed: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of two listings (repo_id, path, stamp, ...) the rows of the first that are new or differ, and the keys of the second that are gone.

    Folders are compared first, by digest, and files only in folders that differ.
    """
    def inside(rows: DataFrame, differ: DataFrame) -> DataFrame:
        branch = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise("")
        return rows.withColumn("branch", branch).join(differ, BRANCH, "left_semi").drop("branch")

    new, old = branches(listed), branches(known)
    same = new.join(old, [*BRANCH, "n", "one", "two"], "left_semi").select(*BRANCH)
    differ = write_shared(new.select(*BRANCH).union(old.select(*BRANCH)).distinct().join(same, BRANCH, "left_anti"), "changed-folders")
    here, there = inside(listed, differ), inside(known, differ)
    changed = here.join(there.select(*KEYS, "stamp"), [*KEYS, "stamp"], "left_anti")
    return changed.select(*listed.columns), there.select(*KEYS).join(here.select(*KEYS), KEYS, "left_anti")


class FactStore:
    """Facts of the files of checked-out repositories, by version: each holds what changed since the one before.

    A version counts once its last folder is written (``listing``, the whole new listing, which is narrow); one that was cut short is
    written over by the next. Facts of a file are those of the newest version that read it, unless it is gone.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.version = -1
        while system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/listing/{self.version + 1}/_SUCCESS")):
            self.version += 1

    def listing(self) -> DataFrame:
        """(repo_id, path, size, stamp, version): the files as of the newest version, and which version read each."""
        return self.spark.read.parquet(f"{self.path}/listing/{self.version}")

    def _current(self, name: str) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/{name}/{v}").withColumn("version", F.lit(v)) for v in range(self.version + 1)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.join(self.listing().select(*KEYS, "version"), [*KEYS, "version"], "left_semi").drop("version")

    def facts(self) -> DataFrame:
        return self._current("facts")

    def readmes(self) -> DataFrame:
        return self._current("readmes")

    def update(self, root: str, ids: DataFrame | None = None) -> int:
        """Bring the store up to the state of the tree; returns the number of files whose text was opened."""
        version = self.version + 1
        listed = write_shared(list_files(self.spark, root, ids, stamps=True), "listed")
        if version:
            changed, _ = changed_files(listed, self.listing())
            changed = write_shared(changed, "changed")
        else:
            changed = listed
        path = F.col("path")
        opened = write_shared(read_listed(changed.filter(needs_text(path) | path.isin(lx.README_NAMES)), root), "opened")
        file_facts(opened).write.mode("overwrite").parquet(f"{self.path}/facts/{version}")
        opened.filter("is_text").filter(path.isin(lx.README_NAMES)).select(*KEYS, "content").write.mode("overwrite").parquet(f"{self.path}/readmes/{version}")
        rows = listed.select(*KEYS, "size", "stamp").join(changed.select(*KEYS, F.lit(version).alias("version")), KEYS, "left")
        if version:
            rows = rows.join(self.listing().select(*KEYS, F.col("version").alias("before")), KEYS, "left").withColumn("version", F.coalesce("version", "before")).drop("before")
        rows.write.mode("overwrite").parquet(f"{self.path}/listing/{version}")
        self.version = version
        return opened.count()

    def analyze(self, repos: DataFrame) -> DataFrame:
        """``analysis.analyze`` of the whole tree, from facts alone: no text is opened."""
        files = self.listing().select(*KEYS).join(self.readmes(), KEYS, "left").withColumn("is_text", F.col("content").isNotNull())
        return analyze(files, repos, self.facts())
