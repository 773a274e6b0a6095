"""Commit tables from exported logs (JSON lines)."""

import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from codelode.operators.ranking import row_numbers
from codelode.sources.shared import write_shared

# workers get this module's functions by value, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EARLIEST = -(1 << 62)
REPOSITORY = 3 << 20  # commits of a repository that one task holds
SHARE = 1 << 17  # commits of small repositories that share a task
BLOCK = 1 << 20  # chains that one task holds
RUN = 1 << 12
COMMIT_SCHEMA = (
    "repo_id int, sha string, author_email string, author_name string, committed_date timestamp_ntz, message string, "
    "walk_pos int"
)
COMMIT_FILE_SCHEMA = (
    "repo_id int, sha string, file_pos int, path string, change_type string, insertions int, deletions int, diff string"
)


def keyed(schema: str, key: str) -> str:
    """The schema with ``repo_id`` of the type ``key``: ``int`` numbers, or ``string`` for repositories known by name."""
    return schema.replace("repo_id int", f"repo_id {key}", 1)


def read_commit_log(
    spark: SparkSession, path: str, ordered: bool = False, mode: str = "FAILFAST", key: str = "int", parents: bool = False
) -> DataFrame:
    """Commits of a log, numbered newest first by date, then sha; ``ordered`` says that the log has walk positions itself.

    With ``parents`` the log has a field of that name, a list of shas, and is numbered as ``walk_commits`` does.

    A line that cannot be read fails the job; another ``mode`` of the JSON source is the caller's choice. ``key`` is the type of
    ``repo_id``: with ``string`` the log joins the files of ``read_files`` by the repositories' names, and with ``int`` those read with
    ``ids``.
    """
    schema = keyed(COMMIT_SCHEMA, key) + (", parents array<string>" if parents else "")
    log = spark.read.schema(schema).option("mode", mode).json(path)
    return log if ordered else walk_commits(log) if parents else number_commits(log)


def number_commits(log: DataFrame) -> DataFrame:
    """Walk positions by date and sha, for repositories of any length."""
    order = [F.desc("committed_date"), F.col("sha")]
    numbered = row_numbers(log.drop("walk_pos"), ["repo_id"], order, "walk_pos")
    return numbered.withColumn("walk_pos", F.col("walk_pos").cast("int"))


def _handed_on(own: np.ndarray, length: np.ndarray, into: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple:
    """Dates at both ends of chains, each taken after all that lead into it, and whether all could be: a cycle never is.

    ``before`` and ``after`` are the ends of links, as positions. Held in flat arrays, some 60 bytes a chain and 16 a link.
    """
    k, order = len(own), np.argsort(before, kind="stable")
    numbers = lambda values: array("q", values.astype(np.int64).tobytes())
    starts, waits = numbers(np.searchsorted(before[order], np.arange(k + 1))), numbers(np.bincount(after, minlength=k))
    after, out, length, into = numbers(after[order]), numbers(np.maximum(own, into + length)), numbers(length), numbers(into)
    ready = array("q", [i for i in range(k) if not waits[i]])
    for i in ready:
        given = out[i] + 1
        for j in after[starts[i]:starts[i + 1]]:
            if given > into[j]:
                into[j] = given
                out[j] = max(out[j], given + length[j])
            waits[j] -= 1
            if not waits[j]:
                ready.append(j)
    return np.array(into, np.int64), np.array(out, np.int64), len(ready) == k


def _corrected(date: np.ndarray, child: np.ndarray, parent: np.ndarray) -> np.ndarray | None:
    """Corrected dates of commits whose edges name them by position; None where a commit leads back to itself.

    Chains are seen through by pointer jumping, and dates are then handed from chain to chain.
    """
    n = len(date)
    pairs = child * np.int64(n) + parent
    pairs.sort()
    if len(pairs) and (same := pairs[1:] == pairs[:-1]).any():  # a commit may name a parent twice
        pairs = pairs[np.concatenate([[True], ~same])]
    child, parent = (pairs // max(n, 1)).astype(np.int32), (pairs % max(n, 1)).astype(np.int32)
    del pairs
    if (child == parent).any():
        return None
    link = (np.bincount(child, minlength=n)[child] == 1) & (np.bincount(parent, minlength=n)[parent] == 1)
    at, newest = np.arange(n, dtype=np.int32), np.ones(n, bool)
    at[child[link]], newest[parent[link]] = parent[link], False
    oldest = at == np.arange(n, dtype=np.int32)
    dist, best = (~oldest).astype(np.int32), date.copy()
    child, parent = child[~link], parent[~link]
    for _ in range(n.bit_length() + 1):
        further = best[at]
        further += dist
        np.maximum(best, further, out=best)
        further = at[at]
        if (further == at).all():
            break
        dist += dist[at]
        at = further
    if not oldest[at].all():
        return None
    chain, ends = (np.cumsum(oldest, dtype=np.int32) - 1)[at], np.flatnonzero(newest)
    del further, at, oldest, newest, link
    own, length = np.empty(len(ends), np.int64), np.empty(len(ends), np.int64)
    own[chain[ends]], length[chain[ends]] = best[ends], dist[ends]
    into, _, whole = _handed_on(own, length, np.full(len(ends), EARLIEST), chain[parent], chain[child])
    return np.maximum(best, into[chain] + dist) if whole else None


def _placed(key: tuple, rows: pa.Table, edges: pa.Table) -> pa.Table:
    """Walk positions of the rows of some whole repositories; 0 for all of them where the parents of a commit lead back to it.

    Ids ascend by repository and sha, and rows that repeat a commit lie side by side. An edge leads from a row to the first row of its
    parent; one from a first row to minus ``n`` tells that the commit has ``n`` rows. ``repo_id`` is null where there is only one.
    """
    ids, child, before = rows.column("id").to_numpy(), edges.column("id").to_numpy(), edges.column("before").to_numpy()
    sort = np.argsort(ids)
    ids, date = ids[sort], rows.column("date").to_numpy()[sort]
    child, many = np.searchsorted(ids, child).astype(np.int32), before < 0
    node = np.arange(len(ids), dtype=np.int32)
    for first, n in zip(child[many].tolist(), before[many].tolist()):
        node[first:first - n] = first
    if many.any():
        latest = date.copy()
        np.maximum.at(latest, node, date)
        date, child, before = latest, child[~many], before[~many]
    corrected = _corrected(date, node[child], np.searchsorted(ids, before).astype(np.int32))
    place = np.zeros(len(ids), np.int32)
    if corrected is not None:
        repo = rows.column("repo_id").take(sort)
        starts = np.concatenate([[True], pc.fill_null(pc.not_equal(repo.slice(1), repo.slice(0, len(repo) - 1)), False).to_numpy()])
        number = np.cumsum(starts, dtype=np.int32) - 1
        order = np.lexsort((-corrected[node], number))  # stable: commits of one date stay by sha
        place[order] = np.arange(len(ids), dtype=np.int32) - np.flatnonzero(starts).astype(np.int32)[number] + 1
    return pa.table({"id": ids, "walk_pos": place})


def _passed_on(key: tuple, chains: pa.Table, links: pa.Table) -> pa.Table:
    """One block of chains with the dates that pass between them."""
    chains = chains.take(pc.sort_indices(chains.column("id"))).combine_chunks()
    ids, own, into, length = (chains.column(c).to_numpy() for c in ("id", "own", "into", "length"))
    before, after = (np.searchsorted(ids, links.column(c).to_numpy()) for c in ("before", "id"))
    into, out, whole = _handed_on(own, length, into, before, after)
    for name, values in (("into", into), ("out", out)):
        chains = chains.set_column(chains.column_names.index(name), name, pa.array(values, pa.int64()))
    return chains.append_column("cyclic", pa.array(np.full(len(ids), not whole)))


def walk_commits(log: DataFrame) -> DataFrame:
    """Walk positions from the graph of ``parents``: no commit before any of its children, else newest first, then by sha.

    Commits are ordered by corrected date: the commit's own, or a microsecond after the latest corrected date of its parents if
    that is later. So clocks that run wrong never put a commit behind its parents, and where they are right the order is by date.

    Rows are numbered by repository and sha, and parents are looked up once, by sha; from there on commits are numbers. A
    repository of at most ``REPOSITORY`` rows is walked whole by one task, which holds some 200 bytes a commit, small ones
    together. Larger ones are walked by ``_by_rounds``.

    Parents that the log does not hold are ignored, a null list is an empty one, and a null date counts as the
    earliest; a graph with a cycle is refused. Of rows that repeat a commit all take positions, side by side; rows without
    repository or sha are left out.
    """
    keys = ["repo_id", "sha"]
    others = [c for c in log.columns if c not in (*keys, "walk_pos", "parents")]
    date = F.coalesce(F.unix_micros(F.col("committed_date").cast("timestamp")), F.lit(EARLIEST))
    read = log.dropna(subset=keys).select(
        *keys, *others, date.alias("__date"), F.col("parents").cast("array<string>").alias("__parents")
    )
    read = write_shared(read, "walk-log").repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = write_shared(read.withColumn("__id", F.monotonically_increasing_id()), "walk-rows")
    found = rows.select(*keys, F.col("__id").alias("id"), F.col("__date").alias("date"), F.col("__parents").alias("parents"))
    # a row for each SHARE commits at most
    sizes = found.groupBy("repo_id").agg(F.count("*").alias("rows"), F.min("id").alias("first")).filter(F.col("rows") > SHARE)
    sizes = write_shared(sizes, "walk-sizes")
    share = F.pmod(F.xxhash64("repo_id"), F.lit(-(-found.count() // SHARE) or 1))
    found = found.join(F.broadcast(sizes), "repo_id", "left").withColumn(
        "slot", F.when(F.col("rows") > REPOSITORY, None).otherwise(F.coalesce(-1 - F.col("first"), share))
    )
    nodes = found.groupBy(*keys).agg(F.min("id").alias("before"), F.count("*").alias("n"), F.max("slot").alias("slot"))
    edges = found.select("repo_id", "id", F.explode("parents").alias("sha")).join(nodes.hint("merge"), keys)
    # ``n`` is read on both sides of the union, so that commits are grouped once
    edges = edges.select("slot", "id", F.when(F.col("n") > 0, F.col("before")).alias("before")).unionByName(
        nodes.filter("n > 1").select("slot", F.col("before").alias("id"), (-F.col("n")).alias("before"))
    )
    edges = write_shared(edges, "walk-edges")
    placed = found.filter("slot IS NOT NULL").select("slot", F.when(F.col("slot") >= 0, F.col("repo_id")).alias("repo_id"), "id", "date").groupBy("slot").cogroup(
        edges.filter("slot IS NOT NULL").groupBy("slot")
    ).applyInArrow(_placed, "id long, walk_pos int")
    placed = write_shared(placed, "walk-placed")
    if not placed.filter("walk_pos = 0").isEmpty():
        raise ValueError("the parents of some commits lead back to them")
    if not sizes.filter(F.col("rows") > REPOSITORY).isEmpty():
        placed = placed.unionByName(_by_rounds(found.filter("slot IS NULL"), edges.filter("slot IS NULL AND before >= 0")))
    return rows.join(placed.select(F.col("id").alias("__id"), "walk_pos").hint("merge"), "__id").select(*keys, *others, "walk_pos")


def _by_rounds(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, walk_pos) of rows of repositories that no task holds; rows and edges are those of ``_placed``.

    Chains of commits with one parent and one child are solved by pointer jumping: each round doubles how far every commit sees,
    with the greatest date and distance on the way, so a chain of 100,000 commits takes 17 rounds. Chains are then dealt by their
    earliest date, which a clock that is fast for a commit does not move, into blocks of some ``BLOCK`` rows. Dates pass inside a block in
    one go, and between blocks until none changes: as many rounds as blocks follow one another within a stretch of wrong dates, of which
    each only looks at the blocks that got a later date. Rounds are joins by commit, so a repository with most commits spreads like any
    other, and nothing is broadcast.
    """
    # a row that repeats a commit counts as its first
    commit = write_shared(found.select("repo_id", "sha", "id").join(
        found.groupBy("repo_id", "sha").agg(F.min("id").alias("node"), F.max("date").alias("date")).hint("merge"), ["repo_id", "sha"]
    ).select("repo_id", "id", "node", "date"), "walk-nodes")
    nodes = commit.filter("id = node").drop("id")
    edges = edges.join(commit.select("id", "node").hint("merge"), "id").select("node", F.col("before").alias("parent"))
    edges = write_shared(edges.distinct(), "walk-links")
    # a link of a chain: an only parent whose only child this is
    one_parent = edges.groupBy("node").agg(F.count("*").alias("n"), F.min("parent").alias("parent")).filter("n = 1").drop("n")
    one_child = edges.groupBy("parent").agg(F.count("*").alias("n")).filter("n = 1").drop("n")
    links = one_parent.join(one_child.hint("merge"), "parent")
    state = nodes.join(links.hint("merge"), "node", "left").select(
        "repo_id", "node", "date", F.coalesce("parent", "node").alias("at"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.col("date").alias("best"), F.col("parent").isNull().alias("done"),
    )
    state, rounds = write_shared(state, "walk-0"), 0
    left = state.filter("NOT done").count()
    limit = left.bit_length() + 1
    while left:
        if rounds > limit:
            raise ValueError("the parents of some commits lead back to them")
        far = state.select(F.col("node").alias("at"), F.col("at").alias("at2"), F.col("dist").alias("dist2"), F.col("best").alias("best2"), F.col("done").alias("done2"))
        moved = state.filter("NOT done").join(far.hint("merge"), "at").select(
            "repo_id", "node", "date", F.col("at2").alias("at"), (F.col("dist") + F.col("dist2")).alias("dist"),
            F.greatest("best", F.col("best2") + F.col("dist")).alias("best"), F.col("done2").alias("done"),
        )
        state, rounds = write_shared(state.filter("done").unionByName(moved), f"walk-{rounds + 1}"), rounds + 1
        left = state.filter("NOT done").count()
    # chains: `at` is the oldest commit of one; what leads into it are the parents of that commit, each the newest of its chain
    chains = state.groupBy("repo_id", F.col("at").alias("chain")).agg(
        F.max(F.struct("dist", "node", "best")).alias("newest"), F.min("date").alias("since")
    ).select("repo_id", "chain", F.col("newest.node").alias("newest"), F.col("newest.dist").alias("length"), F.col("newest.best").alias("own"), "since")
    chains = write_shared(chains, "walk-chains")
    blocks = max(1, -(-chains.count() // BLOCK))
    chains = chains.repartitionByRange(blocks, "repo_id", "since", "chain")
    # written once: block and id name a chain from here on
    chains = write_shared(chains.withColumns({"block": F.spark_partition_id(), "id": F.monotonically_increasing_id()}), "walk-blocks")
    into = edges.join(chains.select(F.col("chain").alias("node"), "block", "id").hint("merge"), "node")
    owner = chains.select(F.col("newest").alias("parent"), F.col("block").alias("before_block"), F.col("id").alias("before"))
    into = write_shared(into.join(owner.hint("merge"), "parent").select("block", "id", "before_block", "before"), "walk-into")
    inside, across = into.filter("block = before_block").select("block", "id", "before"), into.filter("block <> before_block")
    blank = F.lit(EARLIEST).cast("long")
    known = chains.select("block", "id", "own", "length", blank.alias("into"), F.col("own").alias("out"))
    form, todo = "block int, id long, own long, length long, into long, out long, cyclic boolean", None
    rounds, limit = 0, across.count() + 1
    while todo is None or todo:
        if rounds > limit:
            raise ValueError("the parents of some commits lead back to them")
        here, there = (known, inside) if todo is None else (known.filter(F.col("block").isin(todo)), inside.filter(F.col("block").isin(todo)))
        solved = here.groupBy("block").cogroup(there.groupBy("block")).applyInArrow(_passed_on, form)
        if todo is not None:
            solved = solved.unionByName(known.filter(~F.col("block").isin(todo)).withColumn("cyclic", F.lit(False)))
        solved = write_shared(solved, f"walk-known-{rounds}")
        if not solved.filter("cyclic").isEmpty():
            raise ValueError("the parents of some commits lead back to them")
        known, rounds = solved.drop("cyclic"), rounds + 1
        given = across.join(known.select(F.col("block").alias("before_block"), F.col("id").alias("before"), "out").hint("merge"), ["before_block", "before"])
        given = given.groupBy("block", "id").agg((F.max("out") + 1).alias("given"))
        later = known.join(given.hint("merge"), ["block", "id"], "left").select("block", "id", "own", "length", F.greatest("into", "given").alias("into"), "out", (F.col("given") > F.col("into")).alias("moved"))
        later = write_shared(later, f"walk-later-{rounds}")
        todo = [r.block for r in later.filter("moved").select("block").distinct().collect()]  # a number for a block
        known = later.drop("moved")
    solved = chains.select(F.col("chain").alias("at"), "block", "id", "length").join(known.select("block", "id", "into").hint("merge"), ["block", "id"])
    # a chain may be a whole repository: its commits meet it in runs
    run = lambda n: F.floor(F.col(n) / RUN)
    solved = solved.select("at", "into", F.explode(F.sequence(F.lit(0).cast("long"), run("length"))).alias("run"))
    whole = state.withColumn("run", run("dist")).join(solved.hint("merge"), ["at", "run"]).select(
        "node", F.greatest("best", F.col("into") + F.col("dist")).alias("corrected")
    )
    dated = commit.select("repo_id", "id", "node").join(whole.hint("merge"), "node")
    numbered = row_numbers(dated, ["repo_id"], [F.desc("corrected"), F.col("id")], "walk_pos")  # ids ascend by sha
    return numbered.select("id", F.col("walk_pos").cast("int").alias("walk_pos"))


def read_commit_files(spark: SparkSession, path: str, mode: str = "FAILFAST", key: str = "int") -> DataFrame:
    return spark.read.schema(keyed(COMMIT_FILE_SCHEMA, key)).option("mode", mode).json(path)
