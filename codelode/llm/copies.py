"""Numbers for rows that are equal in all that matters, however many there are."""

from pyspark.sql import DataFrame, Window, functions as F

LANES = 64
RUN = 65_536


def with_lane(rows: DataFrame, lane: str = "lane") -> DataFrame:
    return rows.withColumn(lane, F.pmod(F.spark_partition_id(), F.lit(LANES)))


def number_copies(rows: DataFrame, key: list[str], lane: str) -> DataFrame:
    """``rows`` reduced to ``key`` and a number ``copy`` among equal rows, from 0.

    Rows meet as counts only, one for each lane, and are spread out again in runs; so a row that a third of all rows repeat is
    no hot group. Which of several equal rows gets which number makes no difference, so reruns agree.
    """
    counted = rows.groupBy(*key, lane).agg(F.count("*").alias("copies"))
    stop = F.sum("copies").over(Window.partitionBy(*key).orderBy(lane).rowsBetween(Window.unboundedPreceding, 0))
    runs = counted.withColumn("stop", stop).withColumn("first", F.explode(F.sequence(F.col("stop") - F.col("copies"), F.col("stop") - 1, F.lit(RUN))))
    return runs.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + (RUN - 1), F.col("stop") - 1)))).select(*key, "copy")
