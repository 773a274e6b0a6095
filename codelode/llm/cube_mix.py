"""Mixing sources to target weights: cube-method balanced sampling."""

import random
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from codelode.llm.copies import number_copies, with_lane
from codelode.sources.shared import write_shared

WORDS = r"[^\x20\x09-\x0D]+"
CHUNK = 8192  # documents that one flight moves
EDGE = 1e-9


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(source, source_size, n) with weight and target: ``share`` of all sizes by weight, at most ``most`` times a size.

    Sources by code point, null last, take ``weights`` in turn. What a capped source leaves is shared out again by weight among
    the others, until none is above its cap; each round is one small aggregate over the sources, of which one row comes back.
    """
    ranked = write_shared(_numbered(sizes), "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("number") % len(weights) + 1).cast("int"))
    table = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = None, F.lit(False)
    while True:
        held, open_weight = table.agg(
            F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))
        ).first()
        if not open_weight:
            target = F.col("cap")
            break
        left = total - held
        target = F.when(capped, F.col("cap")).otherwise(left * F.col("weight") / open_weight)
        if level == (held, open_weight):
            break
        level = (held, open_weight)
        capped = capped | (left * F.col("weight") / open_weight > F.col("cap"))
    return table.withColumn("target", target).drop("cap", "number")


def _numbered(sizes: DataFrame) -> DataFrame:
    """Each source's place in code-point order, null last: range partitions, and the rows before each of them."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = max(2, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = sizes.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    ranged = write_shared(ranged, "mix-ranges")
    counts = ranged.groupBy("part").agg(F.count("*").alias("rows"))  # one row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    here = Window.partitionBy("part").orderBy(*order)
    return ranged.join(bases, "part").withColumn("number", F.col("base") + F.row_number().over(here) - 1).drop("part", "base")


def flight(sizes: list[float], shares: list[float], rng: random.Random) -> list[float]:
    """Move inclusion probabilities to 0 or 1 but for at most two, keeping the sums of shares and of shares times sizes.

    Any three undecided documents have a direction that changes neither sum; the move along it, one way or the other with
    chances that keep every probability's mean, goes until one of them is decided, and the next document takes its place.
    """
    shares, window = list(shares), []
    for i in range(len(shares)):
        if EDGE < shares[i] < 1 - EDGE:
            window.append(i)
        while len(window) >= 3:
            x = [sizes[j] for j in window]
            u = (x[1] - x[2], x[2] - x[0], x[0] - x[1])
            if u == (0, 0, 0):
                u = (1, -1, 0)
            up = min(((1 - shares[j]) / d if d > 0 else shares[j] / -d) for j, d in zip(window, u) if d)
            down = min((shares[j] / d if d > 0 else (1 - shares[j]) / -d) for j, d in zip(window, u) if d)
            move = up if rng.random() * (up + down) < down else -down
            for j, d in zip(window, u):
                shares[j] = min(1.0, max(0.0, shares[j] + move * d))
                if shares[j] < EDGE:
                    shares[j] = 0.0
                elif shares[j] > 1 - EDGE:
                    shares[j] = 1.0
            window = [j for j in window if 0 < shares[j] < 1]
    return [0.0 if s < EDGE else 1.0 if s > 1 - EDGE else s for s in shares]


def land(sizes: list[float], shares: list[float], drift: float, near: int = 64) -> list[float]:
    """Decide the few documents left: the rounding that keeps the sum of sizes best, one of the ``near`` smallest documents
    changing sides where that helps; then the one that keeps the count best."""
    left = [i for i, s in enumerate(shares) if 0 < s < 1]
    want = drift + sum(shares[i] * sizes[i] for i in left)
    count = sum(shares[i] for i in left)
    small = [i for i in range(max(0, len(sizes) - near), len(sizes)) if i not in left]
    best = None
    for bits in range(1 << len(left)):
        took = [i for k, i in enumerate(left) if bits >> k & 1]
        off = sum(sizes[i] for i in took) - want
        for flip in [None, *small]:
            change = 0 if flip is None else 1 - 2 * shares[flip]
            error = abs(off + change * sizes[flip] if change else off), abs(len(took) + change - count)
            if best is None or error < best[0]:
                best = error, took, flip
    out = list(shares)
    for i in left:
        out[i] = 1.0 if i in best[1] else 0.0
    if best[2] is not None:
        out[best[2]] = 1 - out[best[2]]
    return out


def mix_sources(
    documents: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", seed: int = 7,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, copies, text_hash.

    Every document of a source gets the whole copies of target / source_size, and the rest of that ratio as the probability
    of one more copy. The cube method decides those: documents of a source are dealt into chunks by a hash of their id,
    and a flight in each chunk, from the largest document down, leaves at most two undecided, small ones; chunks'
    remainders meet in chunks of their own, until a source fits one chunk, where the landing decides the last two. So
    tokens and document counts stay balanced at every level, no task sees more than a chunk, and a source with a third of all
    rows is only more chunks. Moves are seeded by source and chunk: reruns agree, whatever the partitioning.

    Defined cases: a null text has size 0 and takes 0 words; null sources are a source, the last; null ids take part;
    rows that repeat an id and text are documents of their own, dealt over chunks by a number among them; an empty table gives no rows. Other columns are ignored.
    """
    text = F.col(text_col)
    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"),
        F.xxhash64(text).alias("text_hash"),
    )
    # equal rows get numbers, so that they too are dealt over chunks
    rows = write_shared(number_copies(with_lane(rows), rows.columns, "lane"), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = write_shared(source_targets(sizes, weights, share, most), "mix-targets").select(
        F.col("source").alias("_source"), "source_size", "n", "target"
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(ratio + EDGE)
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumns({
        "copies": base.cast("int"), "share": F.greatest(ratio - base, F.lit(0.0)), "chunks": F.ceil(F.col("n") / CHUNK).cast("long"),
    })
    dealt = F.xxhash64("doc_id", "text_hash", F.lit(seed))
    dealt = F.when(F.col("copy") == 0, dealt).otherwise(F.xxhash64(dealt, "copy"))
    rows = rows.withColumn("chunk", F.pmod(dealt, F.col("chunks"))).drop("n")
    decided, level = [], 0
    while True:
        moved = write_shared(_flights(rows, seed, level), f"mix-flight-{level}")
        decided.append(moved.filter("share = 0 or share = 1"))
        rows = moved.filter("share > 0 and share < 1")
        if rows.limit(1).count() == 0:
            break
        rows = rows.withColumn("chunks", F.ceil(F.col("chunks") / (CHUNK // 4)).cast("long"))
        rows = rows.withColumn("chunk", F.pmod(F.col("chunk"), F.col("chunks")))
        level += 1
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    copies = F.col("copies") + F.col("share").cast("int")
    return out.select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), "source", copies.alias("copies"), "text_hash"
    )


def _flights(rows: DataFrame, seed: int, level: int) -> DataFrame:
    def move(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values(["size", "doc_id", "text_hash", "copy"], ascending=[False, True, True, True], kind="stable")
        first = chunk.iloc[0]
        name = "" if first["source"] is None else f"s{first['source']}"
        rng = random.Random(zlib.crc32(f"{seed}/{level}/{first['chunk']}/{name}".encode()))
        sizes, shares = chunk["size"].astype(float).tolist(), chunk["share"].tolist()
        moved = flight(sizes, shares, rng)
        if first["chunks"] == 1:
            drift = sum(x * (s - m) for x, s, m in zip(sizes, shares, moved))
            moved = land(sizes, moved, drift)
        chunk["share"] = moved
        return chunk

    return rows.groupBy("source", "chunk", "chunks").applyInPandas(move, rows.schema)


def materialise(documents: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` as often as the mix takes them, with all their columns."""
    takes = mixed.groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    takes = takes.filter("_copies > 0").withColumnsRenamed({"doc_id": "_doc", "text_hash": "_hash"})

    def rows(part: DataFrame) -> DataFrame:
        same = documents[id_col].cast("long").eqNullSafe(part["_doc"]) & (F.xxhash64(documents[text_col]) == part["_hash"])
        return documents.join(part, same)

    # rows that repeat an id and text share their copies
    both = rows(takes.filter("_rows = 1")).union(rows(takes.filter("_rows > 1")).dropDuplicates([id_col, text_col]))
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*documents.columns)
