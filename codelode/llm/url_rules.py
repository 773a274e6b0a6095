"""URL filters: a sort-merge range join of reversed-host keys with nested prefix rules."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from codelode.sources.shared import write_shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """rules(rule, verdict) from (``host/path``, verdict) pairs."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rules))))


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict; rules(rule, verdict) holds ``host/path`` prefixes.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest rule text wins, then the
    longer host. Where none fits, the verdict is ``default``.

    A rule's key is its reversed host, a slash, and its path. Pages bring one key for each of their host's suffixes that is
    no longer than the longest rule host, so that every rule is one interval of sorted keys, and intervals are nested.
    Keys and rules are range-partitioned together (a hash of the id splits runs of one key) and swept in order: each rule
    carries the stack of rules open at its start, a key takes the last stack seen and pops what has closed, and
    each piece of the sweep begins with the rules open at its first key.

    Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule; rules with null or an
    empty host are ignored; of repeated rules with different verdicts ``block`` wins (the greater text); repeated pages and
    null ids give a row each. Other columns are ignored, whatever their names.
    """
    pieces = max(2, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    opened, lengths = _open_rules(rules)
    labels = opened.agg(F.coalesce(F.max(F.size(F.split(F.split("key", "/")[0], "\\."))), F.lit(1))).first()[0]
    page = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    names = F.reverse(F.split(url_host(F.col("url")), "\\."))
    keys = page.select(
        "page_id", "url", F.explode(F.transform(
            F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels))), lambda i: F.concat(F.array_join(F.slice(names, F.lit(1), i), "."), F.lit("/"), url_path(F.col("url")))
        )).alias("key"),
    ).withColumn("is_page", F.lit(True))
    events = keys.unionByName(opened.select("key", "stack", F.lit(False).alias("is_page")), allowMissingColumns=True)
    events = write_shared(
        events.repartitionByRange(pieces, "key", "is_page", F.xxhash64("page_id", "url")).withColumn("piece", F.spark_partition_id()),
        "url-pieces",
    )
    first = events.filter("is_page").groupBy("piece").agg(F.min("key").alias("key"))
    carried = _with_prefixes(first, lengths).join(opened.select(F.col("key").alias("prefix"), "open"), "prefix")
    carried = carried.groupBy("piece", "key").agg(F.sort_array(F.collect_list("open")).alias("stack"))
    events = events.withColumn("at", F.col("is_page").cast("int")).unionByName(
        carried.withColumns({"is_page": F.lit(False), "at": F.lit(-1)}), allowMissingColumns=True
    )
    seen = F.last("stack", ignorenulls=True).over(
        Window.partitionBy("piece").orderBy("key", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    swept = events.withColumn("seen", seen).filter("is_page")
    top = F.element_at(F.filter("seen", lambda r: F.startswith(F.col("key"), r["key"])), -1)
    top = F.when(F.size(F.filter("seen", lambda r: F.startswith(F.col("key"), r["key"]))) > 0, top)
    found = swept.select("page_id", "url", top.alias("top")).groupBy("page_id", "url").agg(
        F.max(F.when(F.col("top").isNotNull(), F.struct(
            F.length("top.rule").alias("size"), F.length("top.key").alias("depth"), F.col("top.rule"), F.col("top.verdict")
        ))).alias("top"), F.count("*").alias("keys"),
    )
    suffixes = F.least(F.size(F.split(url_host(F.col("url")), "\\.")), F.lit(labels))
    return found.withColumn("ordinal", F.explode(F.sequence(F.lit(1), (F.col("keys") / suffixes).cast("int")))).select(
        F.col("page_id").alias(id_col), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
        F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"),
    )


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def _with_prefixes(table: DataFrame, lengths: list[int]) -> DataFrame:
    """Each row with the prefixes of its key that are as long as some rule's key."""
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("key"))
    return table.withColumn("prefix", F.explode(F.transform(fitting, lambda n: F.substr(F.col("key"), F.lit(1), n))))


def _open_rules(rules: DataFrame) -> tuple[DataFrame, list[int]]:
    """(key, open, stack): open is the rule itself, stack the rules that are open at its start, outermost first; and their keys' lengths.

    The distinct lengths are few: a hundred thousand need rules of five billion characters.
    """
    at = F.instr("rule", "/")
    host = F.translate(F.when(at > 0, F.substr(F.col("rule"), F.lit(1), at - 1)).otherwise(F.col("rule")), UPPER, LOWER)
    path = F.when(at > 0, F.substr(F.col("rule"), at)).otherwise("")
    keyed = rules.select(
        F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("/"), path).alias("key"), "rule", "verdict"
    ).filter((F.length("key") > 0) & (F.instr("key", "/") > 1))
    one = keyed.groupBy("key").agg(F.max(F.struct("verdict", "rule")).alias("r")).select(
        "key", F.struct(F.length("key").alias("size"), F.col("key"), F.col("r.rule"), F.col("r.verdict")).alias("open")
    )
    lengths = sorted(r.n for r in one.select(F.length("key").alias("n")).distinct().collect())
    stacks = _with_prefixes(one.select("key"), lengths).join(one.select(F.col("key").alias("prefix"), "open"), "prefix").groupBy("key").agg(
        F.sort_array(F.collect_list("open")).alias("stack")
    )
    return one.join(stacks, "key"), lengths
