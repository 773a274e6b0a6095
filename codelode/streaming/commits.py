"""Commit feeds as streams: feeds land in an inbox, and a gate with keyed state admits each commit once."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from codelode.sources.commit_log import keyed

FEED_SCHEMA = (
    "repo_id int, sha string, author_email string, author_name string, committed_date timestamp_ntz, message string, "
    "walk_pos int, ingest_ts timestamp"
)
DELTA_SCHEMA = (
    "repo_id int, email string, commits long, first_commit timestamp_ntz, last_commit timestamp_ntz, "
    "newest struct<committed_date:timestamp_ntz,sha:string,author_name:string>"
)
KEYS = ["repo_id", "sha"]
ONCE = {"availableNow": True}
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # counting the rows of the state would look each key up once more
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def read_feed(spark: SparkSession, folder: str, files_per_batch: int = 100, mode: str = "FAILFAST", key: str = "int") -> DataFrame:
    """Commits from JSON files as they arrive in a folder; a line that cannot be read fails the batch, unless ``mode`` says else.

    ``key`` is the type of ``repo_id``, here and below, one for all feeds of a target.
    """
    return spark.readStream.schema(keyed(FEED_SCHEMA, key)).option("mode", mode).option("maxFilesPerTrigger", files_per_batch).json(folder)


def contributor_deltas(commits: DataFrame) -> DataFrame:
    """Statistics per contributor of some commits; those of disjoint sets of commits add up (``contributor_counts``).

    The newest commit is the latest by date and sha: positions in a log count from the day of its export.
    """
    return commits.groupBy("repo_id", F.col("author_email").alias("email")).agg(
        F.count("*").alias("commits"), F.min("committed_date").alias("first_commit"), F.max("committed_date").alias("last_commit"),
        F.max(F.struct("committed_date", "sha", "author_name")).alias("newest"),
    )


def contributor_counts(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("repo_id", "email").agg(
        F.sum("commits").alias("commits"), F.min("first_commit").alias("first_commit"), F.max("last_commit").alias("last_commit"),
        F.max("newest").alias("newest"),
    ).select(
        "repo_id", "email", F.col("newest.author_name").alias("name"), "commits", "first_commit", "last_commit",
        F.col("newest.sha").alias("newest_sha"),
    )


def land_commits(spark: SparkSession, feed_folder: str, target: str, checkpoint: str, trigger: dict = ONCE, key: str = "int") -> StreamingQuery:
    """Copy what arrives in a feed into the target's inbox, each commit once per batch; returns the started query.

    Any number of feeds may land in one target at the same time. A batch that runs again after a failure lands its
    commits twice, which the gate does not mind; nothing in the inbox is ever overwritten.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in KEYS]
        first = batch.groupBy(*KEYS).agg(F.min(F.struct("ingest_ts", *[c for c in rest if c != "ingest_ts"])).alias("c"))
        first.select(*[c if c in KEYS else F.col(f"c.{c}") for c in batch.columns]).write.mode("append").parquet(f"{target}/inbox")

    return read_feed(spark, feed_folder, key=key).writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def admit_commits(spark: SparkSession, target: str, files_per_batch: int = 100, trigger: dict = ONCE, key: str = "int") -> StreamingQuery:
    """Store the landed commits that are not stored yet, and the statistics of their contributors; returns the started query.

    What is stored is known by keyed state (RocksDB, below ``target/gate``), looked up key by key, so a batch costs
    what it brings, however much is stored. A key's state is where and when it was first seen, not the commit. Of the versions
    of a commit the earliest by ``ingest_ts`` of the first batch that has any stays whole, and none is dropped by time.
    A batch has a folder of its own, so one that runs again after a failure replaces what it wrote.
    One gate runs for a target at a time; a second one is refused.
    """
    session = spark.newSession()
    for name, value in STATE.items():
        session.conf.set(name, value)
    inbox, schema = _folder(session, f"{target}/inbox"), keyed(FEED_SCHEMA, key)
    landed = session.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("cleanSource", "delete").parquet(inbox)
    # one instant for a batch, kept with its offsets
    marked = landed.select(*KEYS, "ingest_ts", F.col("_metadata.file_path").alias("at"), F.current_timestamp().alias("now"))
    seen = marked.groupBy(*KEYS).agg(F.min(F.struct("ingest_ts", "at")).alias("first"), F.min("now").alias("since"), F.max("now").alias("until"))

    def store(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.filter(F.col("since") == F.col("until")).select(*KEYS, F.col("first.at").alias("at"))
        own = batch.sparkSession
        fresh.write.mode("overwrite").parquet(f"{target}/fresh")  # the state is read once
        fresh = own.read.schema(fresh.schema).parquet(f"{target}/fresh")
        places = [r.at for r in fresh.select("at").distinct().collect()]  # files of one batch
        rows = own.read.schema(schema).parquet(*places or [inbox]).select("*", F.col("_metadata.file_path").alias("at"))
        same = (rows["at"] == fresh["at"]) & rows["repo_id"].eqNullSafe(fresh["repo_id"]) & rows["sha"].eqNullSafe(fresh["sha"])
        rows = rows.join(fresh, same, "left_semi").drop("at")
        rows.write.mode("overwrite").parquet(f"{target}/commits/batch={batch_id}")
        written = own.read.schema(schema).parquet(f"{target}/commits/batch={batch_id}")
        contributor_deltas(written).write.mode("overwrite").parquet(f"{target}/contributors/batch={batch_id}")

    return (
        seen.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{target}/gate").trigger(**trigger).start()
    )


def stream_commits(spark: SparkSession, feed_folder: str, target: str, checkpoint: str, key: str = "int") -> StreamingQuery:
    """Land what a feed holds now and admit it; returns the gate's started query.

    For a feed that keeps running, start ``land_commits`` and ``admit_commits`` with a trigger of their own.
    """
    land_commits(spark, feed_folder, target, checkpoint, key=key).awaitTermination()
    return admit_commits(spark, target, key=key)


def _folder(spark: SparkSession, path: str) -> str:
    """``path``, made if it is missing: a stream cannot watch a folder that is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return path


def _stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(folder).drop("batch")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stored_commits(spark: SparkSession, target: str, key: str = "int") -> DataFrame:
    return _stored(spark, f"{target}/commits", keyed(FEED_SCHEMA, key))


def contributor_table(spark: SparkSession, target: str, key: str = "int") -> DataFrame:
    """Contributor statistics of all that is stored, from the sums of the batches, not from the commits."""
    return contributor_counts(_stored(spark, f"{target}/contributors", keyed(DELTA_SCHEMA, key)))
