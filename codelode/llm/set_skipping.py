"""N-gram Jaccard join: prefix index lists with skipping, and answers derived from those of similar sets."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codelode.llm.memory import tidy
from codelode.llm.words import mix, shingle_sets
from codelode.operators.ranking import likely_rows
from codelode.sources.shared import Scratch, write_shared

KNOWN = 1 << 16  # frequent shingles that the order puts last
BUFFER = 1 << 21  # shingles that are counted at a time
SEEN = 1 << 17  # sets that a task remembers so as not to list equal ones again
GUESS = 3  # lists that a likely pair shares for each one that its leader leads
GRADE = 1.04  # sizes of a block differ by this factor at most
LANE = 1 << 23  # shingles of a family that one task compares with the family's base
SPAN = 1 << 20  # differing shingles of a family that one task holds in an index
STEP = 1 << 22  # index entries that are counted at a time


def _passes(overlap, a, b):
    """100 * overlap >= 80 * union, for sizes a and b; numpy arrays, numbers or columns."""
    return 9 * overlap >= 4 * (a + b)


def _may_link(shared):
    """Whether columns n and m allow a link of sets that share ``shared`` prefix shingles.

    Of two prefixes one ends first in the common order; what the sets share up to there is in both prefixes, and behind
    it that set has all but its prefix left.
    """
    behind = F.greatest(F.ceil(F.col("n") * 8 / 10), F.ceil(F.col("m") * 8 / 10)) - 1
    return _passes(shared + behind, F.col("n"), F.col("m")) & (10 * F.least("n", "m") >= 8 * F.greatest("n", "m"))


def _least_shared(n: Column, m: Column) -> Column:
    """Nine times the prefix shingles that sets of n and m shingles share at least if they link; see ``_may_link``."""
    return 4 * (n + m) - 9 * (F.greatest(F.ceil(n * 8 / 10), F.ceil(m * 8 / 10)) - 1)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that stand for a set in joins."""
    one = mix(s).sum(dtype=np.uint64)
    two = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(np.int64(one)), int(np.int64(two))


@tidy
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (0, id, size, digest, digest, text hash) per document, and (1, shingle, count) of shingles seen thrice in a while."""
    held, size = [], 0

    def frequent():
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        keys, counts = keys[counts > 2], counts[counts > 2]
        none = pa.nulls(len(keys), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(keys), np.int32)), pa.array(keys.view(np.int64)), pa.array(counts), none, none, none], names=list("kabcdt")
        )

    for batch in batches:
        rows = []
        for s in shingle_sets(batch.column(1)):
            rows.append((len(s), *_digest(s)))
            held.append(s)
            size += len(s)
            if size > BUFFER:
                yield frequent()
                held, size = [], 0
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 3)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(rows), np.int32)), batch.column(0), *columns, batch.column(2)], names=list("kabcdt")
        )
    if held:
        yield frequent()


def _prefixes(frequent: np.ndarray, rank: np.ndarray):
    """(key, c, at) of every set's prefix: the shingles that any set similar enough must share one of.

    ``at`` holds the set's size and the shingle's position in the set, in the halves of a number.

    The order of shingles: those not known to be frequent by hash, then the frequent ones by ascending count. Any one
    order of all shingles gives exact answers; this one keeps lists short.
    """

    @tidy
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            for s in shingle_sets(batch.column(0)):
                n = len(s)
                if not n:
                    continue
                c = _digest(s)[0]
                if c in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(c)
                length = n - -(-n * 8 // 10) + 1
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    order = np.argsort(np.where(frequent[at] == s, rank[at], 0), kind="stable")[:length]
                    keys = s[order]
                else:
                    keys = s[:length]
                out.append((keys, c, n))
            sizes = [len(k) for k, _, _ in out]
            columns = [np.zeros(0, np.int64)] * 3
            if out:
                places = np.concatenate([np.arange(x) for x in sizes]) + np.repeat([n << 32 for _, _, n in out], sizes)
                columns = [np.concatenate([k for k, _, _ in out]).view(np.int64), np.repeat([c for _, c, _ in out], sizes), places]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "c", "at"])

    return emit


@tidy
def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of keys that two or more sets have, from rows sorted by key and set; repeated sets of a key once."""
    last = None  # (key, c, at, whether the row before has its key)

    def made(columns):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "c", "at"])

    for batch in batches:
        key, c, where = (x.to_numpy() for x in batch.columns)
        if not len(key):
            continue
        before = False
        if last is not None:
            key, c, where = (np.concatenate(([x], y)) for x, y in zip(last[:3], (key, c, where)))
            before = last[3]
        first = np.concatenate(([True], (key[1:] != key[:-1]) | (c[1:] != c[:-1])))
        key, c, where = key[first], c[first], where[first]
        same = key[1:] == key[:-1]
        live = np.concatenate(([before], same)) | np.concatenate((same, [False]))
        last = (key[-1], c[-1], where[-1], bool(same[-1]) if len(same) else before)
        yield made([x[:-1][live[:-1]] for x in (key, c, where)])
    if last is not None and last[3]:
        yield made([[x] for x in last[:3]])


@tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(*_digest(s), len(s), s.tobytes()) for s in shingle_sets(batch.column(0)) if len(s)]
        columns = list(zip(*rows)) if rows else [()] * 4
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["c", "d", "n", "data"])


@tidy
def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for a, b in zip(batch.column(4), batch.column(5)):
            a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            if len(a) > len(b):
                a, b = b, a
            found.append(int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.int64())], names=["a", "b", "na", "nb", "overlap"])


@tidy
def _diffs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(family, first, sid, n, base, missing, near, diff): what tells each set from its family's base, whose row (sid ``first``) comes first.

    ``diff`` holds the base's shingles that the set lacks, ``missing`` of them, and the set's that the base lacks; ``near`` says
    whether it links with the base.
    """
    group, base, first = None, None, None
    for batch in batches:
        out = []
        for family, lane, kind, sid, data in zip(*(c.to_pylist() for c in batch.columns)):
            data = np.frombuffer(data, np.uint64)
            if kind == 0:
                group, base, first = (family, lane), data, sid
                continue
            assert group == (family, lane)
            lacks = np.setdiff1d(base, data, assume_unique=True)
            diff = np.concatenate((lacks, np.setdiff1d(data, base, assume_unique=True)))
            near = bool(_passes(len(base) - len(lacks), len(base), len(data)))
            out.append((family, first, sid, len(data), len(base), len(lacks), len(diff), near, diff.tobytes()))
        columns = zip(*out) if out else [[]] * 9
        kinds = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
        names = ["family", "first", "sid", "n", "base", "missing", "size", "near", "diff"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


class _Index:
    """Sets of a family by the shingles that tell them from its base, and which of them are known to be one component."""

    def __init__(self, rows: list[tuple]):
        self.sid, self.n, self.missing = (np.array([r[c] for r in rows], np.int64) for c in range(3))
        sizes = [len(r[4]) for r in rows]
        shingles, owner = np.concatenate([r[4] for r in rows]), np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        order = np.argsort(shingles, kind="stable")
        self.shingles, self.owner = shingles[order], owner[order]
        # what links with the base is of one label from the start
        self.label = np.array([0 if r[3] else i + 1 for i, r in enumerate(rows)], np.int64)
        self.root = {int(x): int(x) for x in self.label}
        self.own = {int(s): int(x) for s, x in zip(self.sid, self.label)}

    def _find(self, label: int) -> int:
        while self.root[label] != label:
            self.root[label] = label = self.root[self.root[label]]
        return label

    def shared(self, diff: np.ndarray) -> np.ndarray:
        """How many shingles of ``diff`` each set's difference has too."""
        start, stop = np.searchsorted(self.shingles, diff), np.searchsorted(self.shingles, diff, side="right")
        counts, found = stop - start, np.zeros(len(self.sid), np.int64)
        ends = np.cumsum(counts)
        at = 0
        while at < len(diff):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")))
            c = counts[at:to]
            places = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(start[at:to], c)
            found += np.bincount(self.owner[places], minlength=len(found))
            at = to
        return found

    def links(self, sid: int, n: int, base: int, missing: int, diff: np.ndarray) -> list[int]:
        """Sets that link with this one, one of each component that it was not of; overlaps follow from the differences."""
        overlap = base - missing - self.missing + self.shared(diff)
        hits = np.flatnonzero(_passes(overlap, n, self.n) & (self.sid != sid))
        if sid not in self.own:
            self.own[sid] = len(self.sid) + len(self.own) + 1
            self.root[self.own[sid]] = self.own[sid]
        found = []
        for at in np.unique(self.label[hits], return_index=True)[1]:
            one, two = self._find(self.own[sid]), self._find(int(self.label[hits[at]]))
            if one != two:
                self.root[max(one, two)] = min(one, two)
                found.append(int(self.sid[hits[at]]))
        return found


@tidy
def _family_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that make the components of one family's sets: first come the sets of a block, then those that ask."""
    group, held, index = None, [], None
    for batch in batches:
        found = []
        for family, block, kind, sid, n, base, missing, near, diff in zip(*(c.to_pylist() for c in batch.columns)):
            if group != (family, block):
                group, held, index = (family, block), [], None
            diff = np.frombuffer(diff, np.uint64)
            if kind == 0:
                held.append((sid, n, missing, near, diff))
            elif held or index is not None:
                if index is None:
                    index, held = _Index(held), []
                found += [(sid, other) for other in index.links(sid, n, base, missing, diff)]
        columns = zip(*found) if found else [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, text_hash.

    Two documents link when their sets of five-word shingles have a Jaccard similarity of 0.8 or more; the component is the
    smallest id reachable by links. The join is exact (shingles are 64-bit hashes):

    1. Equal sets become one node. A set's prefix, a fifth of its shingles in an order with frequent ones last, must
       share a shingle with that of any similar set. The frequent ones come from counts over all documents; the table that
       tasks get holds at most ``KNOWN`` of them and only decides the order, never the answers.
    2. Prefix shingles make index lists; those of one set only are dropped. An entry carries the set's size and the
       shingle's position. Each set follows one leader, the one that leads most of its lists; a list is led by the set with the largest share of
       shingles in lists, which near copies have most in common with. Sets that lead to each other make a family.
    3. Lists with several families are read in blocks, one for each family and grade of size: a set skips a whole block if
       it shares too few lists with it, or none at a position early enough for any link. Only sets that remain
       are paired with the members of a block; pairs whose prefixes share enough are compared exactly.
    4. A family derives its answers from those of its base, the set that most follow: members are written as their
       differences from it, which say whether they link with it. The overlap of two others follows from the shingles that both
       differences hold; so those that do not link with the base ask an index of the differences. No pair of a family
       is ever a row: a set reports links only to components that it was not of yet.

    Each task holds a batch of texts, or an index of about a million differing shingles; a large group of copies costs a row per
    prefix shingle and set. Intermediate tables are deleted when all that read them is written.
    Defined cases: null and empty texts, and texts of white space, have no shingles and are their own components; null ids
    link as others do and get the smallest id reached, or null; repeated rows give a row each. Other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession, "ngram")
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    described = scratch.write(
        texts.select("id", "text", F.xxhash64("text")).mapInArrow(_describe, "k int, a long, b long, c long, d long, t long"), "documents"
    )
    docs = described.filter("k = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), "c", "d", F.col("t").alias("text_hash"))
    common = described.filter("k = 1").groupBy("a").agg(F.sum("b").alias("count")).orderBy(F.desc("count"), "a").limit(KNOWN).toPandas()
    frequent = common["a"].to_numpy(np.int64).view(np.uint64)
    rank = np.lexsort((frequent, common["count"].to_numpy(np.int64))).argsort() + 1
    order = np.argsort(frequent)
    prefixes = texts.select("text").mapInArrow(_prefixes(frequent[order], rank[order]), "key long, c long, at long")
    lists = prefixes.repartition("key").sortWithinPartitions("key", "c").mapInArrow(_live, "key long, c long, at long")
    lists = scratch.write(lists, "lists").withColumn("n", F.shiftright("at", 32)).withColumn("pos", F.col("at").bitwiseAND((1 << 32) - 1))

    sets = docs.filter("n > 0").groupBy("n", "c", "d").agg(F.min("doc_id").alias("rep"))
    alive = lists.groupBy("c", "n").agg(F.count("*").alias("live"))
    nodes = scratch.write(sets.join(alive, ["c", "n"]).withColumn("sid", F.monotonically_increasing_id()), "nodes")
    entries = lists.join(nodes.select("c", "n", "sid", (F.col("live") / F.col("n")).alias("share")), ["c", "n"]).drop("c", "at")
    leaders = entries.groupBy("key").agg(F.max(F.struct("share", F.xxhash64("sid").alias("h"), "sid", "n")).alias("lead"))
    led = entries.join(leaders, "key").select("key", "sid", "n", "pos", F.col("lead.sid").alias("leader"), F.col("lead.n").alias("m"))
    led = scratch.write(led, "entries")
    scratch.drop("lists")
    # a pair may share more lists than its leader leads: the choice is a guess, and a wrong one costs comparisons only
    votes = led.filter("sid != leader").groupBy("sid", "leader", "n", "m").agg(F.count("*").alias("lists"))
    votes = votes.filter(_may_link(GUESS * F.col("lists")))
    chosen = votes.groupBy("sid").agg(F.max(F.struct("lists", "leader")).alias("v")).select(F.col("v.leader").alias("a"), F.col("sid").alias("b"))
    chosen = scratch.write(chosen, "chosen")
    families = _components(nodes, chosen, scratch)
    across = scratch.write(_pairs_across(led, families, scratch), "across")
    scratch.drop("entries", "listed")

    members = chosen.select(F.col("a").alias("sid")).union(chosen.select("b")).union(across.select("a")).union(across.select("b")).distinct()
    wanted = nodes.join(members, "sid").join(families.withColumnRenamed("label", "family"), "sid").select("sid", "family", "rep", "n", "c", "d")
    followers = chosen.groupBy(F.col("a").alias("sid")).agg(F.count("*").alias("followers"))
    wanted = scratch.write(wanted.join(followers, "sid", "left"), "followed")
    bases = wanted.groupBy("family").agg(
        F.max(F.struct("followers", "sid"))["sid"].alias("base"), F.count("*").alias("sets"), F.ceil(F.sum("n") / LANE).cast("int").alias("lanes")
    )
    wanted = scratch.write(wanted.join(bases, "family").drop("followers"), "wanted")
    # only texts of wanted sets, and a few others that the exact join then drops
    data = likely_rows(texts.withColumn("id", F.coalesce("id", F.lit(-1))), wanted.select(F.coalesce("rep", F.lit(-1)).alias("id")), ["id"])
    data = data.select("text").mapInArrow(_sets, "c long, d long, n long, data binary").join(wanted, ["c", "d", "n"]).dropDuplicates(["c", "d", "n"])
    data = scratch.write(data.select("sid", "family", "base", "sets", "lanes", "n", "data"), "sets")
    links = scratch.write(_links_within(data, scratch), "links-within").unionByName(_linked(_compare(across, data)))
    labels = _components(nodes, links, scratch)

    grouped = nodes.join(labels, "sid")
    smallest = grouped.groupBy("label").agg(F.min("rep").alias("smallest"))
    found = scratch.write(grouped.join(smallest, "label").select("n", "c", "d", "smallest"), "classes")
    classes = sets.join(found, ["n", "c", "d"], "left").select("n", "c", "d", F.coalesce("smallest", "rep").alias("component_id"))
    classes = scratch.write(classes, "components")
    scratch.drop_but("documents", "components")
    alone = docs.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash")
    return docs.filter("n > 0").join(classes, ["n", "c", "d"]).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "text_hash"
    ).unionByName(alone)


def _pairs_across(entries: DataFrame, families: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b), a < b: pairs of sets of different families that may link.

    Of two families the set of the smaller one asks, in all lists alike, so what it shares with a block is counted whole.
    """
    sizes = families.groupBy("label").agg(F.count("*").alias("size"))
    grade = F.floor(F.log(F.col("n").cast("double")) / float(np.log(GRADE))).cast("int")
    listed = entries.select("key", "sid", "n", "pos").join(families.join(sizes, "label"), "sid").withColumn("grade", grade)
    listed = scratch.write(listed, "listed")
    mixed = listed.groupBy("key").agg(F.min("label").alias("one"), F.max("label").alias("other")).filter("one != other").select("key")
    rows = scratch.write(listed.join(mixed, "key"), "mixed")
    blocks = rows.groupBy("key", F.col("label").alias("label2"), F.col("size").alias("size2"), F.col("grade").alias("grade2")).agg(
        F.min("n").alias("m0"), F.max("n").alias("m1"), F.min("pos").alias("first")
    )
    n, m0, m1 = F.col("n"), F.col("m0"), F.col("m1")
    met = rows.join(blocks, "key").filter(
        (F.struct("size", "label") < F.struct(F.col("size2").alias("size"), F.col("label2").alias("label"))) & (10 * m1 >= 8 * n) & (8 * m0 <= 10 * n)
    )
    # a link shares its first shingle where enough of both sets is still to come
    early = (9 * F.col("pos") <= 5 * n - 4 * m0) & (9 * F.col("first") <= 5 * m1 - 4 * n)
    met = met.groupBy("sid", "n", "label2", "grade2").agg(
        F.count("*").alias("shared"), F.min("m0").alias("m0"), F.max("m1").alias("m1"), F.bool_or(early).alias("early")
    )
    # between two sizes what a link has to share is least at one of them
    worth = met.filter(F.col("early") & (9 * F.col("shared") >= F.least(_least_shared(n, m0), _least_shared(n, m1))))
    asking = rows.select("key", "sid", "n").join(worth.select("sid", F.col("label2").alias("label"), F.col("grade2").alias("grade")), "sid")
    asked = rows.select("key", "label", "grade", F.col("sid").alias("other"), F.col("n").alias("m"))
    pairs = asking.join(asked, ["key", "label", "grade"]).groupBy("sid", "other", "n", "m").agg(F.count("*").alias("lists"))
    return pairs.filter(_may_link(F.col("lists"))).select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b"))


def _links_within(data: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) between sets of one family: enough of them for its components."""
    held = data.filter("sets > 1")
    lanes = F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))
    first = held.filter("sid = base").select("family", lanes.alias("lane"), F.lit(0).alias("kind"), "sid", "data")
    rest = held.select("family", F.pmod(F.xxhash64("sid"), F.col("lanes")).cast("int").alias("lane"), F.lit(1).alias("kind"), "sid", "data")
    both = first.unionByName(rest).repartition("family", "lane").sortWithinPartitions("family", "lane", "kind")
    diffs = both.mapInArrow(_diffs, "family long, first long, sid long, n long, base long, missing long, size long, near boolean, diff binary")
    diffs = scratch.write(diffs, "diffs")
    direct = diffs.filter("near AND sid != first").select(F.col("first").alias("a"), F.col("sid").alias("b"))
    # families with sets that do not link with the base
    spans = diffs.groupBy("family").agg(
        F.bool_and("near").alias("done"), F.greatest(F.ceil(F.sum("size") / SPAN), F.lit(1)).cast("int").alias("blocks")
    ).filter("NOT done").select("family", "blocks")
    spread = diffs.join(spans, "family")
    columns = ["kind", "sid", "n", "base", "missing", "near", "diff"]
    index = spread.withColumn("kind", F.lit(0)).select("family", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("block"), *columns)
    ask = spread.filter("NOT near").withColumn("kind", F.lit(1))
    ask = ask.select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *columns)
    dealt = index.unionByName(ask).repartition("family", "block").sortWithinPartitions("family", "block", "kind")
    return direct.unionByName(dealt.mapInArrow(_family_links, "a long, b long"))


def _compare(pairs: DataFrame, data: DataFrame) -> DataFrame:
    """Pairs (a, b) with their sizes and exact overlap."""
    data = likely_rows(data, pairs.select(F.col("a").alias("sid")).union(pairs.select("b")), ["sid"])
    one = data.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("data").alias("one"))
    two = data.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("data").alias("two"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "one", "two")
    return both.mapInArrow(_overlaps, "a long, b long, na long, nb long, overlap long")


def _linked(compared: DataFrame) -> DataFrame:
    return compared.filter(_passes(F.col("overlap"), F.col("na"), F.col("nb"))).select("a", "b")


def _components(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(sid, label): in each round every node hooks to its smallest neighbour if that is smaller, and edges are contracted."""
    edges = scratch.write(links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), "edges")
    labels = nodes.select("sid", F.col("sid").alias("label"))
    while edges.limit(1).count():
        hooks = scratch.write(edges.groupBy("high").agg(F.min("low").alias("to")), "hooks")
        labels = labels.join(hooks.withColumnRenamed("high", "label"), "label", "left").select("sid", F.coalesce("to", "label").alias("label"))
        lows, highs = hooks.select(F.col("high").alias("low"), F.col("to").alias("x")), hooks.select("high", F.col("to").alias("y"))
        moved = edges.join(lows, "low", "left").join(highs, "high", "left").select(F.coalesce("x", "low").alias("u"), F.coalesce("y", "high").alias("v"))
        edges = scratch.write(moved.filter("u != v").select(F.least("u", "v").alias("low"), F.greatest("u", "v").alias("high")).distinct(), "edges")
    labels = scratch.write(labels, "labels")
    scratch.drop("edges", "hooks")
    return labels


def without_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each component, with all columns; of rows that repeat id and text one stays."""
    found = near_duplicates(documents, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = write_shared(found.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("_rows")), "ngram-kept")
    text = F.coalesce(documents[text_col], F.lit(""))

    def rows(part: DataFrame) -> DataFrame:
        return documents.join(part, documents[id_col].cast("long").eqNullSafe(part["_doc"]) & (F.xxhash64(text) == part["_hash"]), "left_semi")

    return rows(kept.filter("_rows = 1")).union(rows(kept.filter("_rows > 1")).dropDuplicates([id_col, text_col]))
