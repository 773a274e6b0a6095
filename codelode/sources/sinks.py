"""Report and profile writers."""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode.operators.state import saved_names

PROFILE = "repo_name string, content string, metadata string"


def report_json(df: DataFrame, *keys: str) -> DataFrame:
    """One JSON document per row, beside its key columns."""
    body = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("json"))


def write_report_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def save_profiles(profiles: DataFrame, existing: DataFrame, path: str, date: str) -> None:
    """Append profiles(repo_name, ord, content, metadata) under names that are not taken.

    For one writer at a time; ``ProfileStore`` takes several.
    """
    named = saved_names(profiles.select("repo_name", "ord"), existing, date)
    rows = profiles.join(named.select("ord", "name"), "ord").withColumn("saved_on", F.lit(date))
    rows.drop("ord").write.mode("append").partitionBy("saved_on").parquet(path)


class ProfileStore:
    """Saved profiles that any number of writers add to: what is not in the log of commits does not exist.

    A writer first writes its rows, unseen, to folders of its own, then claims the next number of the log: it moves a
    finished entry to that number's name, which fails if another writer's is there. The loser reads what was committed meanwhile,
    gives out names anew and tries the next number; the profiles themselves are written once. So a name is never given
    twice, no reader sees half a commit, and a writer, a task or an executor lost at any moment leaves at most folders that no reader
    opens. Claims are as exclusive as the file system's move without overwriting.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop, self._conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()

    def commits(self) -> list[dict]:
        """The log's entries in order: number, and the folders of rows and names."""
        log = self._hadoop.Path(f"{self.path}/log")
        if not log.getFileSystem(self._conf).exists(log):
            return []
        entries = self.spark.read.schema("number long, rows string, names string").json(log.toString()).collect()
        return sorted((r.asDict() for r in entries), key=lambda c: c["number"])

    def _claim(self, number: int, rows: str, names: str) -> bool:
        """Whether the entry of this number is ours now."""
        unseen, entry = (self._hadoop.Path(f"{self.path}/log/{n}") for n in (f".{names}", f"{number:012d}.json"))
        system = unseen.getFileSystem(self._conf)
        out = system.create(unseen, False)
        out.write(bytearray(json.dumps({"number": number, "rows": rows, "names": names}).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(system.getUri(), self._conf)
        no_overwriting = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(unseen, entry, no_overwriting)
        except Exception as e:
            system.delete(unseen, False)
            if "FileAlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
            return False
        return True

    def read(self) -> DataFrame:
        """Committed profiles: name, repo_name, content, metadata, saved_on."""
        return self._read(self.commits())

    def _read(self, commits: list[dict]) -> DataFrame:
        out = self.spark.createDataFrame([], f"name string, {PROFILE}, saved_on string")
        if not commits:
            return out
        rows = self.spark.read.schema(f"ord long, {PROFILE}, saved_on string, entry string").option("basePath", f"{self.path}/rows")
        names = self.spark.read.schema("ord long, name string, entry string").option("basePath", f"{self.path}/names")
        rows = rows.parquet(*[f"{self.path}/rows/entry={c['rows']}" for c in commits])
        names = names.parquet(*[f"{self.path}/names/entry={c['rows']}-{c['names']}" for c in commits])
        names = names.withColumn("entry", F.substring_index("entry", "-", 1))
        return rows.join(names, ["entry", "ord"]).select(*out.columns)

    def save(self, profiles: DataFrame, date: str, tries: int = 100) -> int:
        """Add profiles(repo_name, ord, content, metadata), ``ord`` being unique; returns the number of the commit."""
        rows = uuid.uuid4().hex
        stored = profiles.select(F.col("ord").cast("bigint").alias("ord"), "repo_name", "content", "metadata", F.lit(date).alias("saved_on"))
        stored.write.parquet(f"{self.path}/rows/entry={rows}")
        wanted = self.spark.read.schema(stored.schema).parquet(f"{self.path}/rows/entry={rows}").select("repo_name", "ord")
        for _ in range(tries):
            commits, names = self.commits(), uuid.uuid4().hex
            given = saved_names(wanted, self._read(commits).select("name"), date).select("ord", "name")
            given.write.parquet(f"{self.path}/names/entry={rows}-{names}")
            number = commits[-1]["number"] + 1 if commits else 0
            if self._claim(number, rows, names):
                return number
        raise RuntimeError(f"no number of the log could be claimed in {tries} tries")
