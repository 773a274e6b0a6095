"""Row numbers and running totals that no single task has to compute for a whole key."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from codelode.sources.shared import write_shared


def top_k(df: DataFrame, keys: list, order: list[Column], k: int, position: str) -> DataFrame:
    """First ``k`` rows per key, numbered from 1.

    Spark turns the filter on a row number into a group limit that runs before the shuffle, so at
    most ``k`` rows per key leave a task however large the key is.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(position, F.row_number().over(window)).filter(F.col(position) <= F.lit(k))


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, by: list[str], how: str = "inner", spread: int = 32) -> DataFrame:
    """Join rows with a table of one row per key, where one key may hold a large share of the rows.

    The small rows are repeated ``spread`` times and the large side is dealt over (key, hash of ``by``), so no task gets
    all rows of a key whichever join the planner picks.
    """
    slot = "__slot"
    copies = per_key.withColumn(slot, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint"))))
    return rows.withColumn(slot, F.pmod(F.xxhash64(*by), F.lit(spread))).join(copies, [key, slot], how).drop(slot)


FILTER_WORDS = 1 << 20  # 64-bit words of a key filter: all that is ever broadcast


def likely_rows(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is among those of ``wanted``, and a few others, without a shuffle of the rows.

    The wanted keys set one bit each of a filter of ``FILTER_WORDS`` words, of which at most as many as there are keys are
    broadcast: at most some 32 MB whatever the number of keys. More keys only let more other rows pass, so an exact join has to follow.
    """
    def marked(df: DataFrame) -> DataFrame:
        code = F.xxhash64(*keys)
        return df.withColumns({"__word": F.pmod(code, F.lit(FILTER_WORDS)), "__bit": F.pmod(F.shiftright(code, 40), F.lit(64)).cast("int")})

    one = F.expr("shiftleft(1L, __bit)")
    words = marked(wanted.select(*keys)).groupBy("__word").agg(F.bit_or(one).alias("__bits"))
    passed = marked(rows).join(F.broadcast(words), "__word").filter(F.getbit("__bits", "__bit") == 1)
    return passed.drop("__word", "__bit", "__bits")


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """Running sum of ``value`` per key in ``order`` (a total order), current row included.

    Rows are range partitioned by key and order, so a large key spreads over many partitions; each
    (key, partition) piece is summed on its own and shifted by the subtotals of the pieces before it.
    """
    piece = "__piece"
    ranged = (
        df.withColumn("__value", value.cast("bigint"))
        .repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn(piece, F.spark_partition_id())
    )
    # written once: both reads below must see the same range boundaries
    ranged = write_shared(ranged, "ranged")
    within = Window.partitionBy(*keys, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, piece)
        .agg(F.sum("__value").alias("__subtotal"))
        .withColumn("__offset", F.coalesce(F.sum("__subtotal").over(earlier), F.lit(0)))
        .drop("__subtotal")
    )
    counted = ranged.withColumn("__within", F.sum("__value").over(within))
    return (
        counted.join(offsets, [*keys, piece])
        .withColumn(out, F.col("__within") + F.col("__offset"))
        .drop(piece, "__value", "__within", "__offset")
    )


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """1-based row number per key in a total order, for keys of any size."""
    return running_total(df, keys, order, F.lit(1), out)


def page_rows(df: DataFrame, keys: list[str], order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of ``df`` in ``order``, a total order over columns ``keys`` that name a row.

    Only the keys are sorted, by range partitions: those before the page are skipped by their counts, and what is
    sorted whole is the partition or two that hold the page. The page's rows are then looked up by their keys, at most ``limit``.
    """
    piece = "__piece"
    ranged = write_shared(df.select(*keys).repartitionByRange(*order).withColumn(piece, F.spark_partition_id()), "page-keys")
    counts = ranged.groupBy(piece).agg(F.count("*").alias("n")).orderBy(piece).collect()  # a row per partition
    before, held = 0, []
    for r in counts:
        if before + r.n > offset and before < offset + limit:
            held.append((r[piece], before))
        before += r.n
    first = held[0][1] if held else 0
    chosen = ranged.filter(F.col(piece).isin([p for p, _ in held])).drop(piece)
    page = chosen.orderBy(*order).offset(offset - first if held else 0).limit(limit)
    same = None
    page = page.select(*[F.col(k).alias(f"__{k}") for k in keys])
    for k in keys:
        one = df[k].eqNullSafe(page[f"__{k}"])
        same = one if same is None else same & one
    return df.join(F.broadcast(page), same, "left_semi").orderBy(*order)


def side_by_side(keys: DataFrame, key: str, parts: list[DataFrame]) -> DataFrame:
    """The rows of ``keys`` with the columns of all parts, each with at most one row per key: left joins by one aggregate.

    The parts' rows meet once, by key, however many parts there are; a plan of as many joins costs far more to make and run.
    """
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    columns = [c for c in merged.columns if c != key]
    gathered = merged.groupBy(key).agg(*[F.any_value(c, ignoreNulls=F.lit(True)).alias(c) for c in columns])
    return keys.join(gathered, key, "left")
