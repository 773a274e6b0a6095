"""Search over an index: each distinct text once, its grams as postings, and candidates checked by the pattern itself."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codelode.functions import paths, text
from codelode.functions.grams import gram_lists, required
from codelode.operators.ranking import top_k
from codelode.operators.search import invalid_pattern, is_valid, line_hits, searchable
from codelode.sources.shared import shared_folder

POSTINGS = "gram int, bucket int, ids array<int>"
MOST_BUCKETS = 4096
RAREST = 4  # grams of a list of which all are needed


class SearchIndex:
    """Folders of one index: ``texts`` by bucket, ``postings`` by gram, ``grams`` with counts, ``places`` of each version of the files.

    Texts are kept by the hash of their content, so a text in many files, or in an earlier version of them, is stored, cut into
    grams and searched once. Buckets of texts are chosen by that hash and read only if they hold a candidate. A posting names
    many texts of a bucket by four bytes of a hash each; two texts of one number are candidates together, and the pattern decides.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        if not 0 < buckets <= MOST_BUCKETS:
            raise ValueError(f"1 to {MOST_BUCKETS} buckets")
        self.spark, self.path, self.buckets, self.places, self.versions = spark, path, buckets, None, []

    def _table(self, name: str, schema: str) -> DataFrame:
        parts = [f"{self.path}/{name}/version={v}" for v in self.versions]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*parts)

    def texts(self) -> DataFrame:
        return self._table("texts", "digest string, content string, bucket int, version string")

    def postings(self) -> DataFrame:
        return self._table("postings", "gram int, bucket int, ids array<int>, part int, version string")

    def add(self, files: DataFrame) -> "SearchIndex":
        """Index the current files; texts that the index has already are neither stored nor cut again.

        A version that was not written to its end is never read: it is listed here only after its last table.
        """
        version = uuid.uuid4().hex
        shown = searchable(files).filter("content IS NOT NULL").select("repo_id", "path", F.sha2("content", 256).alias("digest"), "content")
        shown.drop("content").write.parquet(f"{self.path}/places/{version}")
        # equal texts meet in their bucket: one shuffle of the texts
        bucket = F.pmod(F.xxhash64("digest"), F.lit(self.buckets)).cast("int")
        fresh = shown.select("digest", "content", bucket.alias("bucket"))
        if self.versions:
            fresh = fresh.join(self.texts().select("digest"), "digest", "left_anti")
        here = lambda name: f"{self.path}/{name}/version={version}"
        fresh = fresh.repartition("bucket").dropDuplicates(["bucket", "digest"]).sortWithinPartitions("bucket", "digest")
        fresh.write.partitionBy("bucket").parquet(here("texts"))
        written = self.spark.read.schema("digest string, content string, bucket int").parquet(here("texts"))
        postings = written.select("bucket", text_id(), "content").mapInArrow(gram_lists, POSTINGS)
        part = F.pmod("gram", F.lit(64)).cast("int")
        # a gram that most texts hold is dealt by the texts' bucket as well
        dealt = postings.withColumn("part", part).repartition("part", F.pmod("bucket", F.lit(8)))
        dealt.sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(here("postings"))
        stored = self.spark.read.schema("gram int, ids array<int>, part int").parquet(here("postings"))
        stored.groupBy("gram").agg(F.sum(F.size("ids").cast("long")).alias("texts")).repartition("gram").sortWithinPartitions("gram").write.parquet(here("grams"))
        self.versions.append(version)
        self.places = version
        return self

    def counts(self, grams: list[int]) -> dict[int, int]:
        """Number of texts that hold each of a pattern's grams."""
        table = self._table("grams", "gram int, texts long, version string").filter(F.col("gram").isin(grams))
        return {r.gram: r.n for r in table.groupBy("gram").agg(F.sum("texts").alias("n")).collect()}


def text_id() -> Column:
    """The number of a text in postings, beside its bucket."""
    return F.hash("digest").alias("id")


def build_index(files: DataFrame, path: str | None = None, buckets: int = 256) -> SearchIndex:
    spark = files.sparkSession
    return SearchIndex(spark, path or f"{shared_folder(spark)}/search-{uuid.uuid4().hex}", buckets).add(files)


def _grams(formula) -> set[int]:
    return {formula} if isinstance(formula, int) else set().union(*map(_grams, formula[1]))


def _rarest(formula, counts: dict[int, int]):
    """The formula with only the rarest grams of each list of needed ones: still met by every match."""
    if isinstance(formula, int):
        return formula
    parts = [_rarest(p, counts) for p in formula[1]]
    if formula[0] == "and":
        alone = sorted((p for p in parts if isinstance(p, int)), key=lambda g: counts.get(g, 0))[:RAREST]
        parts = alone + [p for p in parts if not isinstance(p, int)]
    return (formula[0], tuple(parts))


def _holds(formula, have: Column) -> Column:
    if isinstance(formula, int):
        return F.array_contains(have, formula)
    out = None
    for part in formula[1]:
        one = _holds(part, have)
        out = one if out is None else out & one if formula[0] == "and" else out | one
    return out


def candidates(index: SearchIndex, pattern: str) -> DataFrame | None:
    """(id, bucket) of the texts that hold what the pattern needs; None if it needs nothing that the index knows."""
    formula = required(pattern)
    if formula is None:
        return None
    formula = _rarest(formula, index.counts(sorted(_grams(formula))))
    grams = sorted(_grams(formula))
    found = index.postings().filter(F.col("part").isin(sorted({g % 64 for g in grams})) & F.col("gram").isin(grams))
    found = found.select("gram", "bucket", F.explode("ids").alias("id"))
    if isinstance(formula, int):
        return found.select("id", "bucket")
    have = found.groupBy("id", "bucket").agg(F.collect_set("gram").alias("have"))
    return have.filter(_holds(formula, F.col("have"))).select("id", "bucket")


def search_index(index: SearchIndex, pattern: str, max_results: int = 50) -> DataFrame:
    """What ``search_code`` finds in the files that were indexed last, from the index.

    Grams that every match must hold pick candidate texts from the postings of the rarest ones, only the buckets with a candidate
    are read, and their lines are checked by the pattern. A pattern without such grams scans all distinct texts.
    """
    spark, regex = index.spark, text.java_regex(pattern, "diu")
    if not is_valid(spark, pattern, regex):
        return invalid_pattern(spark, pattern)
    texts, chosen = index.texts(), candidates(index, pattern)
    if chosen is not None:
        buckets = [r.bucket for r in chosen.select("bucket").distinct().collect()]  # at most MOST_BUCKETS
        texts = texts.filter(F.col("bucket").isin(buckets)).withColumn("id", text_id()).join(chosen, ["bucket", "id"], "left_semi")
    hits = line_hits(texts, ["digest"], pattern, regex)
    places = spark.read.parquet(f"{index.path}/places/{index.places}")
    found = places.join(hits, "digest")
    first = top_k(found, ["repo_id"], [paths.parts(F.col("path")), F.col("line")], max_results, "position")
    return first.select("repo_id", "path", "line", "content", F.lit(None).cast("string").alias("error"))
