"""Merkle dataset manifest: levels of parents built by slot pivots, and proofs read from the same pivoted rows."""

from pyspark.sql import Column, DataFrame, functions as F

from codelode.operators.ranking import row_numbers, running_total, spread_join
from codelode.sources.shared import write_shared

LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
LANES = 64  # pieces that rows equal in every hashed column are counted in
RUN = 1 << 16


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def leaf_digest(*values: Column) -> Column:
    """SHA-256 (32 bytes) of the values one after the other, each ``-`` if null, else UTF-8 byte count, ``:``, value."""
    parts = [v.cast("string") for v in values]
    return _digest(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]))


def no_tampering(documents: DataFrame) -> dict[str, Column]:
    return {}


def manifest(
    documents: DataFrame, columns: list[str] = LEAF_COLUMNS, id_col: str = "doc_id", tree_col: str = "source", fanout: int = 3,
    tampered=no_tampering,
) -> DataFrame:
    """One row per document: doc_id, source, leaf, seen_leaf, subroot, root (digests of 32 bytes) and path.

    The documents of one source are the leaves of a tree, in ascending order of id; the roots of the sources, in order of
    their names' bytes, are the leaves of the tree above them. A level is built from the one below by a slot pivot: a row per
    parent, with a conditional aggregate for each of its ``fanout`` slots. Its columns concatenated are what the parent
    hashes; without a child's own column they are that child's siblings. So the way down needs no table of nodes
    again: parents hand their path to the pivoted row, which spreads it over its slots. ``path`` lists, from leaf to root,
    what stands ``before`` and ``after`` the node in its run.

    ``tampered`` maps the documents to replacements of hashed columns; ``seen_leaf`` is the leaf of the row with
    them, as a reader would find it, while all else is of the original.

    How it spreads: every level is one aggregate by (source, parent), of at most ``fanout`` rows a group, so a source with a third
    of all rows is no hot key. Positions come from range partitions with offsets. Each level is written, about a third
    of the one below; a row holds ``2 * fanout`` digests for each level at most.

    Defined cases: nulls are hashed as ``-``; a null source is a source of its own and comes first; a null id comes
    first in its source; rows with equal ids come in order of their leaves, then of their tampered leaves, and rows equal in all of these take
    neighbouring places; an empty text differs from a null one; a tree of one leaf is its own root; an empty table gives
    no rows. Further columns are ignored, whatever their names.
    """
    known = {c: documents[c] for c in dict.fromkeys([*columns, id_col, tree_col])}
    changed = known | tampered(documents)
    facts = documents.select(
        F.coalesce(F.concat(F.lit("s"), known[tree_col].cast("string")), F.lit("")).alias("tree"), known[id_col].alias("doc_id"),
        leaf_digest(*[known[c] for c in columns]).alias("digest"), leaf_digest(*[changed[c] for c in columns]).alias("seen"),
        F.pmod(F.spark_partition_id(), F.lit(LANES)).alias("lane"),
    )
    # rows equal in everything meet as counts only, some in each lane
    counted = write_shared(facts.groupBy("tree", "doc_id", "digest", "seen", "lane").agg(F.count("*").alias("copies")), "merkle-facts")
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "digest", "seen", "lane")]
    placed = running_total(counted, ["tree"], order, F.col("copies"), "stop")
    runs = placed.withColumn("first", F.explode(F.sequence(F.col("stop") - F.col("copies"), F.col("stop") - 1, F.lit(RUN))))
    last = F.least(F.col("first") + (RUN - 1), F.col("stop") - 1)
    nodes = runs.withColumn("pos", F.explode(F.sequence("first", last))).select("tree", "pos", "digest", "doc_id", "seen")
    sizes = write_shared(counted.groupBy("tree").agg(F.sum("copies").alias("n")), "merkle-sizes")
    nodes = write_shared(spread_join(nodes, sizes, "tree", ["pos"]), "merkle-leaves")

    levels, tops = _raise(nodes, _height(sizes.agg(F.max("n")).first()[0], fanout), fanout)
    roots = row_numbers(tops.withColumn("all", F.lit(0)), ["all"], [F.col("tree")], "number")
    roots = roots.select(F.lit("").alias("tree"), (F.col("number") - 1).alias("pos"), "digest", F.col("tree").alias("doc_id"), F.lit(b"").alias("seen"))
    total = sizes.count()
    roots = write_shared(roots.withColumn("n", F.lit(total).cast("long")), "merkle-roots")
    upper, summit = _raise(roots, _height(total, fanout), fanout)
    summit = summit.select("tree", "level", F.lit(b"").alias("subroot"), F.col("digest").alias("root"), _no_path().alias("path"))
    sources = _lower(roots, upper, summit, fanout)
    sources = write_shared(sources.select(F.col("doc_id").alias("tree"), F.col("digest").alias("subroot"), "root", "path"), "merkle-sources")
    tops = tops.select("tree", "level").join(sources, "tree")
    return _lower(nodes, levels, tops, fanout).select(
        "doc_id", F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias("source"), F.col("digest").alias("leaf"),
        F.col("seen").alias("seen_leaf"), "subroot", "root", "path",
    )


def fold(leaf: Column, path: Column) -> Column:
    """The root (hex text) that ``leaf`` and the siblings of ``path`` give."""
    return F.aggregate(path, _hex(leaf), lambda node, p: F.sha2(F.concat(_hex(p["before"]), node, _hex(p["after"])), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path as hex text, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda p: F.concat(_hex(p["before"]), _hex(p["after"]))))


def verified_documents(documents: DataFrame, tampered=no_tampering, fanout: int = 3) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), digests as hex text; see ``manifest``.

    ``folded_root`` is what a reader of the (tampered) row computes from its leaf and the manifest's siblings.
    """
    proved = manifest(documents, tampered=tampered, fanout=fanout)
    return proved.select(
        "doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"),
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), fold(F.col("seen_leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _no_path() -> Column:
    return F.lit([]).cast("array<struct<before:binary,after:binary>>")


def _height(n: int | None, fanout: int) -> int:
    """Levels above ``n`` leaves."""
    n, height = n or 1, 0
    while n > 1:
        n, height = -(-n // fanout), height + 1
    return height


def _raise(nodes: DataFrame, height: int, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The pivoted levels above ``nodes`` (tree, pos, digest, n nodes in the tree, ...), and each tree's root with its level."""
    levels, tops = [], []
    for level in range(height + 1):
        tops.append(nodes.filter("n = 1").select("tree", "digest", F.lit(level).alias("level")))
        if level == height:
            break
        payload = ["digest"] if level else ["digest", "doc_id", "seen"]
        slots = [F.max(F.when(F.col("pos") % fanout == j, F.struct(*payload))).alias(f"slot{j}") for j in range(fanout)]
        pivoted = nodes.filter("n > 1").groupBy("tree", "n", F.floor(F.col("pos") / fanout).alias("parent")).agg(*slots)
        levels.append(write_shared(pivoted, f"merkle-level{level}"))
        run = F.concat_ws("", *[_hex(F.col(f"slot{j}.digest")) for j in range(fanout)])
        nodes = levels[-1].select("tree", F.col("parent").alias("pos"), _digest(run).alias("digest"), F.ceil(F.col("n") / fanout).alias("n"))
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return levels, out


def _lower(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """All leaves (tree, doc_id, digest, seen, subroot, root, path), each path begun by the leaf's own siblings."""

    def roots(level: int) -> DataFrame:
        return tops.filter(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("parent"), "subroot", "root", "path")

    answers = roots(len(levels))
    for level in reversed(range(len(levels))):
        # the level's position comes with the join: no null in the keys, trees being marked text
        spread = levels[level].join(answers, ["tree", "parent"]).withColumn("child", F.explode(F.array(*[_child(j, fanout) for j in range(fanout)])))
        spread = spread.filter(F.col("child.node").isNotNull())
        path = F.concat(F.array(F.struct(F.col("child.before").alias("before"), F.col("child.after").alias("after"))), "path").alias("path")
        if level:
            answers = spread.select("tree", (F.col("parent") * fanout + F.col("child.slot")).alias("parent"), "subroot", "root", path)
            answers = answers.unionByName(roots(level))
            if level % 4 == 0:  # keeps plans small, however high the tree
                answers = write_shared(answers, f"merkle-answers{level}")
        else:
            leaves = spread.select("tree", "child.node.doc_id", "child.node.digest", "child.node.seen", "subroot", "root", path)
    alone = nodes.filter("n = 1").join(roots(0), "tree").select("tree", "doc_id", "digest", "seen", "subroot", "root", "path")
    return leaves.unionByName(alone) if levels else alone


def _child(j: int, fanout: int) -> Column:
    """What slot ``j`` of a pivoted row holds: the node, and the other slots before and after it."""
    others = [F.coalesce(F.col(f"slot{k}.digest"), F.lit(b"")) for k in range(fanout)]
    return F.struct(
        F.lit(j).alias("slot"), F.col(f"slot{j}").alias("node"), F.concat(F.lit(b""), *others[:j]).alias("before"),
        F.concat(F.lit(b""), *others[j + 1 :]).alias("after"),
    )
