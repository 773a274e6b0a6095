"""File tables from directory trees of checked-out repositories."""

import os
import sys
import uuid
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode.operators.ranking import row_numbers, spread_join
from codelode.sources.shared import write_shared

# workers get this module's functions by value, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ENTRIES = "folder string, name string, is_folder boolean, size long, modified long"
READ = "repo_id string, path string, size long, content binary"
BATCH_BYTES = 8 << 20
ENTRY_ROWS = 10_000
FOLDERS_A_TASK = 16


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


def list_files(spark: SparkSession, root: str, ids: DataFrame | None = None, skip_folders: Collection[str] = (), stamps: bool = False) -> DataFrame:
    """Every regular file below ``root/<repository>/``: (repo_id, path, size, at), names of any form included.

    Spark's file sources skip names that begin with ``.`` or ``_``, which repositories are full of, so the tree is listed
    with Arrow's file systems (local, HDFS, S3, GCS). All listing is done by tasks, level by level: a round deals the folders of
    one depth over tasks, whichever repository they belong to, writes their entries, and finds the folders of the next.
    So one repository with most of all folders is listed by many tasks, and a round costs a job for each level of depth only.

    ``repo_id`` is the repository's folder name, or with ``ids(name, repo_id)`` the number or key that it gives to that
    name; repositories it does not name are left out before they are listed. ``skip_folders`` names folders that are not entered at
    any depth. ``stamps`` adds a column ``stamp`` of size and time of change, by which a file is known as
    unchanged; a store that tells no times makes all files new in every listing. Links to folders are not followed. A folder that vanishes between two rounds counts as empty.
    """
    files, base = _open(root.rstrip("/"))
    base, skipped = base.rstrip("/"), frozenset(skip_folders)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _open(root.rstrip("/"))
        local = isinstance(files, fs.LocalFileSystem)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = files.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=True))
                for at in range(0, len(found), ENTRY_ROWS):
                    part = [i for i in found[at : at + ENTRY_ROWS] if i.type in (fs.FileType.File, fs.FileType.Directory)]
                    part = [i for i in part if i.type == fs.FileType.File or i.base_name not in skipped and not (local and os.path.islink(i.path))]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([folder] * len(part), pa.string()), pa.array([i.base_name for i in part], pa.string()),
                        pa.array([i.type == fs.FileType.Directory for i in part], pa.bool_()), pa.array([i.size for i in part], pa.int64()),
                        pa.array([i.mtime_ns for i in part], pa.int64()),
                    ], names=["folder", "name", "is_folder", "size", "modified"])

    levels, most = [], 4 * spark.sparkContext.defaultParallelism
    folders, count = spark.createDataFrame([("",)], "folder string"), 1
    while count:
        # a given number of tasks: the rows are few and small, and would else be put into one
        tasks = max(1, min(most, -(-count // FOLDERS_A_TASK)))
        found = write_shared(folders.repartition(tasks, "folder").mapInArrow(entries, ENTRIES), f"listing-{len(levels)}")
        path = F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name"))
        folders = found.filter("is_folder").select(path.alias("folder"))
        if not levels and ids is not None:
            folders = folders.join(ids.select(F.col("name").alias("folder")).distinct(), "folder", "left_semi")
        levels.append(found.filter("NOT is_folder").select(path.alias("below"), "size", "modified"))
        count = folders.count()
    listed = levels[0].filter("false")  # files beside the repositories belong to none
    for level in levels[1:]:
        listed = listed.unionByName(level)
    listed = listed.select(
        F.substring_index("below", "/", 1).alias("repo_id"), F.expr("substring(below, instr(below, '/') + 1)").alias("path"), "size",
        F.concat(F.lit(f"{base}/"), "below").alias("at"),
        F.concat(F.col("size").cast("string"), F.lit(":"), F.coalesce(F.col("modified").cast("string"), F.lit(uuid.uuid4().hex))).alias("stamp"),
    )
    if not stamps:
        listed = listed.drop("stamp")
    if ids is None:
        return listed
    keys = ids.select(F.col("name").alias("__name"), F.col("repo_id").alias("__id"))
    # one row per repository, and a repository may hold most files: those are dealt over slots before they meet it
    keyed = spread_join(listed.withColumnRenamed("repo_id", "__name"), keys, "__name", ["path"])
    return keyed.select(F.col("__id").alias("repo_id"), *listed.columns[1:])


def repository_ids(names: DataFrame) -> DataFrame:
    """(name, repo_id): numbers from 1 in order of the distinct names, for ``list_files`` and logs that carry names."""
    numbered = row_numbers(names.select("name").distinct().withColumn("__all", F.lit(0)), ["__all"], [F.col("name")], "repo_id")
    return numbered.select("name", F.col("repo_id").cast("int").alias("repo_id"))


def read_files(
    spark: SparkSession, root: str, max_bytes: int | None = None, ids: DataFrame | None = None, skip_folders: Collection[str] = ()
) -> DataFrame:
    """Every regular file below ``root/<repository>/``: (repo_id, path, size, is_text, content); see ``list_files``.

    Files are dealt out by a hash of their path before they are read, so a large repository is read by many tasks. Bytes
    that are no UTF-8 are dropped from the text. ``max_bytes`` rules files out before they are opened. Operators
    that need only paths can take ``list_files``.
    """
    listed = list_files(spark, root, ids, skip_folders)
    return read_listed(listed if max_bytes is None else listed.filter(F.col("size") <= max_bytes), root)


def read_listed(listed: DataFrame, root: str) -> DataFrame:
    """The texts of listed files, see ``read_files``; only these files are opened."""
    key = listed.schema["repo_id"].dataType
    listed = listed.select(F.col("repo_id").cast("string").alias("repo_id"), "path", "size", "at")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _open(root.rstrip("/"))
        rows, held = [], 0

        def made():
            columns = list(zip(*rows)) or [()] * 4
            types = (pa.string(), pa.string(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["repo_id", "path", "size", "content"])

        for batch in batches:
            for repo, path, size, at in zip(*(c.to_pylist() for c in batch.columns)):
                with files.open_input_stream(at) as stream:
                    rows.append((repo, path, size, stream.read()))
                held += size
                if held > BATCH_BYTES:
                    yield made()
                    rows, held = [], 0
        if rows:
            yield made()

    raw = listed.repartition("repo_id", "path").mapInArrow(read, READ)
    return raw.select(
        F.col("repo_id").cast(key).alias("repo_id"), "path", "size", F.is_valid_utf8(F.col("content").cast("string")).alias("is_text"), valid_text(F.col("content")).alias("content")
    )


def valid_text(raw):
    """Text of bytes, with invalid sequences dropped rather than replaced."""
    as_text = raw.cast("string")
    # a replacement character that the file really holds is kept: only invalid texts are repaired
    repaired = F.replace(F.make_valid_utf8(as_text), F.lit("�"), F.lit(""))
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(repaired)
