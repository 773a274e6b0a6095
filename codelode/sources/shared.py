"""Written intermediate tables in the cluster's shared checkpoint folder."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all machines of a cluster must share.

    Where it is unset, a session on one machine gets a folder of its own for as long as it lives; on a cluster that
    is an error, as a machine-local folder would lose what other machines wrote. The setting cannot change while a
    session runs, so the stand-in is kept under a name of our own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("codelode.shared.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="codelode-shared-")
        spark.conf.set("codelode.shared.dir", folder)
    return folder.rstrip("/")


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table and read it back.

    Plans that read one expensive frame from several branches (a content scan, a range
    partitioning) use this, so that the work runs once and no executor loss can change it.
    """
    spark = df.sparkSession
    target = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


class Scratch:
    """Intermediate tables of one job, each in a folder of its own, that are deleted once nothing reads them again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back; a name that is used again gets one more folder."""
        paths = self.paths.setdefault(name, [])
        paths.append(f"{self.folder}/{name}-{len(paths)}")
        df.write.parquet(paths[-1])
        return self.spark.read.schema(df.schema).parquet(paths[-1])

    def drop(self, *names: str) -> None:
        """Delete tables; all that was made of them has to be written by now."""
        for name in names:
            for path in self.paths.pop(name, []):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop_but(self, *names: str) -> None:
        self.drop(*[n for n in self.paths if n not in names])
