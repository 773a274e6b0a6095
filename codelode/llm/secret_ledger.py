"""Secret scans: an incremental blob ledger keyed by content address and rule version."""

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from codelode.sources.shared import shared_folder, write_shared

# Kind, pattern, group that must be long enough, least length of that group.
BASE_RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
LEDGER = (
    "sha256 string, rule_version string, n_assign long, n_access long, n_hex long, spans string"
)


def rule_version(rules=BASE_RULES) -> str:
    """The address of a rule set: findings are valid for one text and one version."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def scan_with_ledger(
    documents: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", rules=BASE_RULES
) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, text_sha256.

    ``ledger`` names a folder of (sha256, rule_version, findings) rows. Texts are addressed by SHA-256; of the addresses
    that have no row for this rule version one text each is scanned and its findings are appended; then the findings are
    joined back to every document with that address. A second run over the same folder scans nothing, a new
    rule version scans every text once, new documents scan only texts that were never seen.

    The patterns that stand for base rules find runs of the least length at once; that equals finding all runs and dropping
    the short ones, as a run cannot begin inside another. The assignment rule is matched in full and then filtered.
    Spans are code points, end exclusive, ``kind:start:end`` by start and then kind, comma-joined.

    Copies of a text meet as (id, address) rows only: one text per address is chosen by an aggregate, and the join back reads
    stored tables, where Spark splits a hot address. Defined cases: a null text is empty and has no spans; null and
    repeated ids give a row each; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark, version = documents.sparkSession, rule_version(rules)
    text = F.coalesce(F.col(text_col), F.lit(""))
    paths = write_shared(documents.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("sha256")), "ledger-paths")
    known = _read_ledger(spark, ledger).filter(F.col("rule_version") == version).select("sha256")
    rows = paths.groupBy("sha256", "doc_id").agg(F.count("*").alias("n"))
    unseen = rows.groupBy("sha256").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "n")).alias("row")).join(
        known, "sha256", "left_anti"
    )
    unseen = write_shared(unseen.select("sha256", F.col("row.doc_id").alias("chosen"), F.col("row.n")), "ledger-unseen")
    texts = documents.select(F.col(id_col).alias("id"), text.alias("blob"))

    def blobs(part: DataFrame) -> DataFrame:
        return texts.join(part, F.col("id").eqNullSafe(F.col("chosen")) & (F.sha2("blob", 256) == F.col("sha256"))).select("sha256", "blob")

    # the chosen id names one row, but for rows that repeat it with the same text
    blobs = blobs(unseen.filter("n = 1")).union(blobs(unseen.filter("n > 1")).dropDuplicates(["sha256"]))
    scanned = find_spans(blobs, "blob", rules).withColumn("rule_version", F.lit(version))
    target = f"{ledger.rstrip('/')}/run-{uuid.uuid4().hex}"
    scanned.select("sha256", "rule_version", "n_assign", "n_access", "n_hex", "spans").write.parquet(target)
    findings = _read_ledger(spark, ledger).filter(F.col("rule_version") == version).drop("rule_version").dropDuplicates(["sha256"])
    findings = write_shared(findings, "ledger-findings")
    return paths.join(findings, "sha256").select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans", F.col("sha256").alias("text_sha256")
    )


def find_spans(blobs: DataFrame, text_col: str = "blob", rules=BASE_RULES) -> DataFrame:
    """Per sha256 a count for each kind and the sorted spans; blobs(sha256, text) hold a text for each address.

    Matches are rows while their positions are summed, so a text with millions of them costs no more than its share.
    """
    text = F.col(text_col)
    kinds = [kind for kind, *_ in rules]
    hits = [F.struct(F.lit(i).alias("kind"), F.lit(least).alias("least"), _pieces(text, pattern, group).alias("pieces"))
            for i, (_, pattern, group, least) in enumerate(rules)]
    found = blobs.select("sha256", F.explode_outer(F.filter(F.array(*hits), lambda h: F.size(h["pieces"]) > 0)).alias("hit"))
    rows = found.select("sha256", "hit.kind", "hit.least", F.posexplode_outer("hit.pieces").alias("at", "piece"))
    before = Window.partitionBy("sha256", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    gap, size, long = (F.col(f"piece.{i}") for i in "012")
    rows = rows.repartition("sha256").withColumn(
        "start", F.coalesce(F.sum(gap.cast("long") + F.coalesce(size, F.lit(0))).over(before), F.lit(0)) + gap
    )
    span = F.when(long >= F.col("least"), F.struct("start", "kind", (F.col("start") + size).alias("end")))
    names = F.array(*map(F.lit, kinds))
    return rows.select("sha256", "kind", span.alias("span")).groupBy("sha256").agg(
        *(F.count(F.when(F.col("kind") == i, F.col("span"))).alias(f"n_{kind}") for i, kind in enumerate(kinds)),
        F.array_sort(F.collect_list("span")).alias("spans"),
    ).withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","))


def _pieces(text: Column, pattern: str, group: int) -> Column:
    """Lengths of (text before a match, match, judged group) for all matches in order; empty where nothing matches."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lengths = F.arrays_zip(*(F.transform(a, F.length) for a in (F.split(text, pattern, -1), whole, judged)))
    return F.when(F.regexp_like(text, F.lit(pattern)), lengths).otherwise(F.array())


def new_ledger(spark: SparkSession) -> str:
    """A fresh ledger folder beside the other shared tables."""
    return f"{shared_folder(spark)}/secret-ledger-{uuid.uuid4().hex}"


def _read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All rows of the ledger; none where the folder does not exist yet."""
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(ledger.rstrip("/"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        columns = (F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(LEDGER))
        return spark.range(0).select(*columns)
