"""Exact dedup: tree-merge of sorted digest runs."""

from pyspark.sql import Column, DataFrame, functions as F

from codelode.sources.shared import write_shared

KEY = ["digest", "n_bytes", "check"]


def exact_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 8,
    normalise=lambda text: text,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, copies.

    Rows are dealt over lanes by a hash of their id, and every lane holds a sorted run of the texts it saw. In each round
    ``fan_in`` neighbouring lanes hand their runs to one, which merges them and retains one row per text: the identifier
    to keep and the count. A text that a third of all rows share therefore meets in one task only as one row per lane.
    The answers go back down the same tree, so no join ever brings the rows of a hot text together either.
    Texts count as equal when SHA-256, byte length and a second hash all agree; every merge compares the three.

    The lane count is the power of ``fan_in`` at or above ``spark.sql.shuffle.partitions``.

    Defined cases: a null text is an empty text; a null id never wins over another id, and a group of null ids keeps one of
    them; rows that repeat id and text are all returned (``copies`` says how many there are) and one of them is kept;
    an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    lanes, rounds = _lanes(documents.sparkSession, fan_in)
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    rows = documents.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("check"),
    ).withColumn("lane", F.pmod(F.xxhash64("doc_id"), F.lit(lanes)))
    leaves = write_shared(
        rows.repartition(*KEY, "lane").groupBy(*KEY, "lane", "doc_id").agg(F.count("*").alias("copies"))
        .sortWithinPartitions(*KEY, "lane"), "dedup-leaves",
    )
    run = leaves.groupBy(*KEY, "lane").agg(best("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    runs = []
    for _ in range(rounds):
        run = run.withColumn("lane", _parent("lane", fan_in)).groupBy(*KEY, "lane").agg(
            best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
        )
        run = write_shared(run.sortWithinPartitions(*KEY, "lane"), "dedup-run")
        runs.append(run)
    answers = runs.pop()
    for run in reversed(runs):
        answers = _hand_down(run.drop("keep_id", "group_size"), answers, fan_in)
    judged = _hand_down(leaves, answers, fan_in)
    return judged.withColumn("ordinal", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("ordinal") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "copies",
    )


def without_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=lambda text: text
) -> DataFrame:
    """The kept rows of ``documents`` with all their columns; of rows that repeat id and text one stays."""
    kept = exact_duplicates(documents, id_col, text_col, keep, normalise=normalise).filter("kept")
    kept = write_shared(kept.select("doc_id", "text_sha256", "copies"), "dedup-kept")
    text = normalise(F.coalesce(documents[text_col], F.lit("")))

    def rows(part: DataFrame) -> DataFrame:
        part = part.select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha"))
        return documents.join(part, documents[id_col].eqNullSafe(part["_keep"]) & (F.sha2(text, 256) == part["_sha"]), "left_semi")

    single, repeated = kept.filter("copies = 1"), kept.filter("copies > 1")
    return rows(single).union(rows(repeated).dropDuplicates([id_col, text_col]))


def _lanes(spark, fan_in: int) -> tuple[int, int]:
    rounds, wanted = 1, int(spark.conf.get("spark.sql.shuffle.partitions"))
    while fan_in**rounds < wanted:
        rounds += 1
    return fan_in**rounds, rounds


def _parent(lane: str, fan_in: int) -> Column:
    return F.floor(F.col(lane) / fan_in).cast("long")


def _hand_down(run: DataFrame, answers: DataFrame, fan_in: int) -> DataFrame:
    return run.withColumn("parent", _parent("lane", fan_in)).join(
        answers.withColumnRenamed("lane", "parent"), [*KEY, "parent"]
    ).drop("parent")
