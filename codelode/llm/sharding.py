"""Sharding: fixed virtual slots, and a stored, versioned map from slots to shards that is edited to rebalance."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codelode.llm.copies import number_copies
from codelode.sources.shared import shared_folder, write_shared

MOST_SLOTS = 16_384  # bounds the map, which is broadcast
EDIT = "version int, slot int, shard int"
ROW_BYTES = 16


class SlotMap:
    """Edits (version, slot, shard) in a Parquet folder; the shard of a slot is that of its newest edit up to a version.

    A version is one folder, written once and whole, so a reader of a version sees the same map for ever.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.version = spark, path, -1

    def append(self, edits: DataFrame) -> "SlotMap":
        version = self.version + 1
        edits.select(F.lit(version).cast("int").alias("version"), F.col("slot").cast("int"), F.col("shard").cast("int")).coalesce(1).write.parquet(
            f"{self.path}/version={version:06d}"
        )
        self.version = version
        return self

    def at(self, version: int | None = None) -> DataFrame:
        """(slot, shard) as of ``version``, the newest by default."""
        version = self.version if version is None else version
        parts = [f"{self.path}/version={v:06d}" for v in range(version + 1)]
        edits = self.spark.read.schema(EDIT).option("basePath", self.path).parquet(*parts)
        return edits.groupBy("slot").agg(F.max_by("shard", "version").alias("shard"))

    def shards(self) -> int:
        return self.at().agg(F.max("shard")).first()[0] + 1


def new_map(spark: SparkSession, slots: int, shards: int, path: str | None = None) -> SlotMap:
    """Version 0: neighbouring slots go round the shards. The number of slots never changes afterwards."""
    if not 0 < shards <= slots <= MOST_SLOTS:
        raise ValueError(f"1 to {MOST_SLOTS} slots, and not more shards than slots")
    table = SlotMap(spark, path or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}")
    return table.append(spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") % shards).alias("shard")))


def rebalance(table: SlotMap, weights: DataFrame, weight: str = "bytes") -> SlotMap:
    """Append the edits that even out the shards' weights, as few as a largest-first rule needs.

    Each shard keeps its heaviest slots up to the mean; the rest, mostly light ones, go one by one, heaviest first, to
    the shard with least. ``weights`` has a row per slot; both tables are bounded by the number of slots.
    """
    return table.append(_moves(table, weights, weight, table.shards(), False))


def grow(table: SlotMap, weights: DataFrame, weight: str = "bytes") -> SlotMap:
    """Append the edits that fill one more shard; slots move only into it, the lighter ones of each shard that exceed the new mean."""
    return table.append(_moves(table, weights, weight, table.shards() + 1, True))


def _moves(table: SlotMap, weights: DataFrame, weight: str, shards: int, only_new: bool) -> DataFrame:
    held = table.at().join(weights.select("slot", F.col(weight).alias("w")), "slot", "left").withColumn("w", F.coalesce("w", F.lit(0)).cast("long"))
    by_weight = Window.partitionBy("shard").orderBy(F.desc("w"), "slot").rowsBetween(Window.unboundedPreceding, 0)
    mean = (held.agg(F.sum("w")).first()[0] or 0) / shards
    held = held.withColumn("running", F.sum("w").over(by_weight))
    # one row of at most MOST_SLOTS loose slots and `shards` loads
    loose = F.col("running") - (F.col("w") / 2 if only_new else F.lit(0)) > mean
    row = held.agg(
        F.reverse(F.array_sort(F.collect_list(F.when(loose, F.struct("w", "slot"))))).alias("loose"),
        F.collect_list(F.when(~loose, F.struct("shard", "w"))).alias("kept"),
    )
    zero = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.lit(0).cast("long"))
    loads = F.aggregate("kept", zero, lambda a, k: F.transform(a, lambda x, i: x + F.when(i == k["shard"], k["w"]).otherwise(F.lit(0))))

    def deal(state, slot):
        least = F.lit(shards - 1) if only_new else (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i == least, x + slot["w"]).otherwise(x)).alias("loads"),
            F.concat(state["to"], F.array(least)).alias("to"),
        )

    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("to"))
    dealt = row.withColumn("to", F.aggregate("loose", start, deal)["to"])
    moved = dealt.select(F.explode(F.arrays_zip(F.col("loose.slot").alias("slot"), F.col("to").alias("shard"))).alias("m")).select("m.slot", "m.shard")
    return moved.join(table.at().withColumnRenamed("shard", "was"), "slot").filter("shard != was")


def _hash_slot(slots: int, *values: Column) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(slots)).cast("int")


def records(documents: DataFrame, slots: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A narrow row per document: doc_id, size, text_crc32, digest, copy (number among equal rows, from 0), virtual (its slot).

    A record's slot is a hash of its id, its text and ``copy``; so any process finds it again, and a row that repeats many times spreads
    over slots all the same. Equal rows are counted, in lanes, before they meet.
    """
    text = F.col(text_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")
    key = ["doc_id", "size", "text_crc32", "digest"]
    facts = documents.select(
        F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("digest"),
        F.pmod(F.spark_partition_id(), F.lit(64)).alias("lane"),
    )
    numbered = number_copies(facts, key, "lane")
    return numbered.select(*key, "copy", _hash_slot(slots, F.col("doc_id"), F.col("digest"), F.col("copy")).alias("virtual"))


def place(
    documents: DataFrame, shards: int = 40, slots: int = 8192, table: SlotMap | None = None, id_col: str = "doc_id", text_col: str = "text",
    piece: int = 100_000,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual, copy): the place of each row.

    Rows are hashed into ``slots`` fixed virtual slots, bytes are summed by slot, and the shard comes from ``table``: by default a new map, rebalanced
    once with these sums. The law is ``bytes``: shards come out near equal in bytes, as near as the lightest loose slots allow; one
    document that outweighs a shard's share cannot be split. ``slot`` numbers the rows of a shard from 0, by virtual slot; numbers within a
    virtual slot are taken in pieces of about ``piece`` rows, so no task numbers a whole shard. ``grown_shard`` is null, as only
    the law of keys has it; ``grow`` adds a shard to a map.

    Only narrow rows are shuffled; the map (at most 16,384 rows) is broadcast. Defined cases: a null text has no bytes, and the checksum
    0 of none; null and repeated ids and rows equal in all are records each; an empty table gives no rows. Further columns are ignored, whatever their names.
    """
    spark = documents.sparkSession
    rows = write_shared(records(documents, slots, id_col, text_col), "shard-records")
    weights = write_shared(rows.groupBy("virtual").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).withColumnRenamed("virtual", "slot"), "shard-slots")
    if table is None:
        table = rebalance(new_map(spark, slots, shards), weights)
    largest = weights.agg(F.max("n")).first()[0] or 1
    parts = -(-largest // piece)
    part = F.pmod(F.xxhash64("digest", "doc_id", "copy", F.lit(7)), F.lit(parts)).cast("int")
    placed = rows.withColumn("part", part).join(F.broadcast(table.at().withColumnRenamed("slot", "virtual")), "virtual")
    # rows before each (virtual slot, part) of its shard: a table of slots x parts, each part at most some `piece` rows
    before = Window.partitionBy("shard").orderBy("virtual", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "virtual", "part").agg(F.count("*").alias("n")).select(
        "virtual", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("virtual", "part").orderBy(F.col("doc_id").asc_nulls_first(), "digest", "size", "copy")
    numbered = placed.withColumn("row", F.row_number().over(inside)).join(counts, ["virtual", "part"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("row") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual", "copy", "digest",
    )


def write_shards(documents: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write (doc_id, text, slot, copy) to ``path/shard=…`` in order of slots and read it back.

    A repeated row's text is fetched once and joined to all its places; AQE splits such a join.
    """
    texts = documents.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_digest"), F.col(text_col).alias("text"))
    texts = texts.dropDuplicates(["_id", "_digest"])
    rows = placed.join(texts, placed["doc_id"].eqNullSafe(texts["_id"]) & (placed["digest"] == texts["_digest"]))
    rows = rows.select("shard", "slot", "doc_id", "copy", "text").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)
    return documents.sparkSession.read.schema("slot long, doc_id long, copy long, text string, shard int").parquet(path)
