"""Hard-negative mining over an STR-packed R-tree: boxes bound inner products, a best-first queue visits what may still count."""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from codelode.sources.shared import write_shared

PAGE, NODE = 1024, 64  # rows of a page and of a node of it
SAMPLE = 8192  # rows that the slab borders are read from
BOXES = 1 << 22  # components of all strips' lower corners together
LEAST_STRIP = 4096
BATCH = 100_000  # anchors of a lane
EXACT = float(1 << 53)
LOW, HIGH = -(1 << 63), (1 << 63) - 1
PAGES = "strip int, lane int, kind int, key long, ids binary, labels binary, data binary, lo binary, hi binary"
FOUND = "anchor long, wish int, vec_id long, score long"


def floored(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def hard_negatives(
    embeddings: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", strip_rows: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), scores being inner products of floored components.

    An anchor's positives are its ``positives`` best rows of its own label; for each, the ``negatives`` best rows of other
    labels whose score lies between ``low`` and ``high`` percent of the positive's, bounds included. Ties go to the smaller id.

    The tree: rows are sorted by label and by slabs of the three coordinates that vary most (sort-tile-recursive;
    slab borders are quantiles of a sample of about 8,192 rows, which shapes boxes only: every row is indexed), then cut into
    strips, pages of 1,024 rows and nodes of 64 rows, each with its minimum bounding box and label range. A box gives an interval for the
    inner products with an anchor, coordinate by coordinate. An anchor first searches the strip whose box reaches highest, then all
    other strips whose interval meets a score window at or above the kth best score found. Inside a strip a queue
    takes the highest box first and ends where no window can gain.

    How it spreads: a strip's pages stay where they were packed; anchors travel to the strips that may hold an answer, in lanes of
    about 100,000 anchors. A task holds one strip (``strip_rows``; by default the rows over four times the shuffle
    partitions, or what keeps all strips' boxes below 4,194,304 components, and 4,096 at least) and streams its anchors. The
    boxes of all strips are all that reaches the driver besides the sample.

    Exact: in doubles while sums stay below 2**53, else in whole numbers; components and scores beyond 64 bits are cut
    to the nearest. Defined cases: rows with a null id or label or a vector that is null or holds null or non-finite components
    take no part; shorter vectors count as if filled with zeros, empty ones score 0; rows that carry an anchor's id are not its positives
    or negatives; rows that repeat an id are candidates each, and anchors each; a positive without negatives gives no row, nor
    does one with a negative score, whose window is empty; an empty table gives none. Further columns are ignored, whatever their names.
    """
    spark = embeddings.sparkSession
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("vec_id"), (F.col(label_col) if label is None else label).cast("long").alias("label"),
        F.col(vector_col).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    rows = write_shared(rows.withColumn("v", floored(F.col("v"), scale)), "rtree-rows")
    stat = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.count_if("is_anchor").alias("anchors")).first()
    dims = max(1, stat.dims or 1)
    if strip_rows is None:
        partitions = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        strip_rows = max(LEAST_STRIP, -(-stat.n // partitions), -(-stat.n * dims // BOXES))
    strips = -(-stat.n // strip_rows) or 1
    pages = _pack(rows, stat.n, dims, strips)
    boxes = _boxes(pages, dims)

    lanes = -(-stat.anchors // BATCH) or 1
    anchors = rows.filter("is_anchor").select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "v")
    anchors = write_shared(anchors, "rtree-anchors")
    every = F.array(F.struct(F.lit(LOW).cast("long").alias("lo"), F.lit(HIGH).cast("long").alias("hi")))
    friends = _nearest(anchors.withColumn("wishes", every), pages, boxes, dims, lanes, positives, True)
    friends = friends.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # one window per positive; its place in the list is the wish
    listed = friends.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("positive_score", "positive_id"))).alias("friends"))
    listed = write_shared(listed.join(anchors, "anchor").withColumn("wishes", F.transform("friends", lambda f: F.struct(
        _up(f["positive_score"], low).alias("lo"), F.when(f["positive_score"] < 0, LOW).otherwise(_down(f["positive_score"], high)).alias("hi")
    ))), "rtree-positives")
    found = _nearest(listed.select("anchor", "vec_id", "label", "v", "wishes"), pages, boxes, dims, lanes, negatives, False)
    wished = listed.select("anchor", F.col("vec_id").alias("anchor_id"), F.posexplode("friends").alias("wish", "friend"))
    return wished.join(found, ["anchor", "wish"]).select(
        "anchor_id", F.col("friend.positive_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("friend.positive_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def _down(score: Column, percent: int) -> Column:
    return F.floor(score.cast("decimal(38,0)") * percent / 100).cast("long")


def _up(score: Column, percent: int) -> Column:
    return F.ceil(score.cast("decimal(38,0)") * percent / 100).cast("long")


def _slabs(sample: np.ndarray, slabs: int) -> tuple[list[int], list[float], list[list[float]]]:
    """Three coordinates, the borders of the first one's slabs, and of the second one's within each of these."""
    axes = [int(a) for a in np.argsort(-sample.var(axis=0), kind="stable")[:3]] if len(sample) else [0]
    axes += axes[-1:] * (3 - len(axes))
    if slabs < 2 or not len(sample):
        return axes, [], [[]]
    steps = np.arange(1, slabs) / slabs
    first = np.quantile(sample[:, axes[0]], steps)
    slab = np.searchsorted(first, sample[:, axes[0]], side="right")
    inner = [sample[slab == s, axes[1]] for s in range(slabs)]
    return axes, first.tolist(), [np.quantile(x, steps).tolist() if len(x) else [] for x in inner]


def _pack(rows: DataFrame, n: int, dims: int, strips: int) -> DataFrame:
    """Pages: a row per page of a strip, (strip, key: page number, ids, labels, data, lo, hi), rows of data by dims doubles."""
    sampled = rows.sample(min(1.0, SAMPLE / max(n, 1)), seed=12).select("label", "v").limit(2 * SAMPLE).collect()
    sample = np.zeros((len(sampled), dims))
    for at, r in enumerate(sampled):
        sample[at, : len(r.v)] = r.v
    pages_a_label = n / PAGE / max(1, len({r.label for r in sampled}))
    axes, first, inner = _slabs(sample, max(1, min(64, round(pages_a_label ** (1 / 3)))))

    def at(axis: int) -> Column:
        return F.coalesce(F.get("v", F.lit(axis)), F.lit(0.0))

    def slab(borders: Column, axis: int) -> Column:
        return F.size(F.filter(borders.cast("array<double>"), lambda b: b <= at(axis)))

    def as_array(values: list[float]) -> Column:
        return F.array(*[F.lit(float(x)) for x in values]).cast("array<double>")

    borders = F.array(*[as_array(x) for x in inner])
    tiled = rows.withColumn("slab1", slab(as_array(first), axes[0])).withColumn("slab2", slab(F.get(borders, "slab1"), axes[1]))
    # the last key splits rows that are equal in all others
    tiled = tiled.withColumn("slab3", at(axes[2])).withColumn("tie", F.monotonically_increasing_id())
    order = ["label", "slab1", "slab2", "slab3", "vec_id", "tie"]
    ranged = tiled.repartitionByRange(strips, *order).sortWithinPartitions(*order).select("vec_id", "label", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strip, page, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while len(held) >= PAGE:
                yield _page(strip, page, held.slice(0, PAGE), dims)
                held, page = held.slice(PAGE), page + 1
        if held is not None and len(held):
            yield _page(strip, page, held, dims)

    return write_shared(ranged.mapInArrow(pack, PAGES), "rtree-pages")


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return values.reshape(len(lengths), dims)
    data = np.zeros((len(lengths), dims))
    data[np.arange(dims)[None, :] < lengths[:, None]] = values
    return data


def _page(strip: int, page: int, rows: pa.Table, dims: int) -> pa.RecordBatch:
    data = _matrix(rows.column("v").combine_chunks(), dims)
    ids, labels = (rows.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
    return _rows([(strip, 0, 0, page, ids.tobytes(), labels.tobytes(), _small(data), data.min(axis=0).tobytes(), data.max(axis=0).tobytes())])


def _small(data: np.ndarray) -> bytes:
    """The numbers in two bytes each where all fit, else in eight; ``_large`` tells them by the length."""
    return (data.astype("<i2") if np.abs(data).max(initial=0) < 1 << 15 else data.astype("<f8")).tobytes()


def _large(data: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if len(data) == 2 * n * dims else "<f8").astype(np.float64).reshape(n, dims)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 3 + [pa.int64()] + [pa.binary()] * 5
    columns = zip(*rows) if rows else [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in PAGES.split(", ")])


class Boxes:
    """Minimum bounding boxes with label ranges; ``corners`` holds lower and upper ones side by side."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.corners, self.first, self.last = np.hstack((lo, hi)), first, last

    def intervals(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product that each box allows."""
        up, down = np.maximum(query, 0), np.minimum(query, 0)
        both = self.corners @ np.column_stack((np.concatenate((up, down)), np.concatenate((down, up))))
        return both[:, 0], both[:, 1]

    def admits(self, label: int, same: bool) -> np.ndarray:
        return (self.first <= label) & (label <= self.last) if same else (self.first != label) | (self.last != label)


def _boxes(pages: DataFrame, dims: int) -> tuple[np.ndarray, Boxes]:
    """The numbers of all strips and their boxes; read page by page inside tasks, one row per strip to the driver."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for strip, labels, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("strip", "labels", "lo", "hi"))):
                labels, lo, hi = np.frombuffer(labels, np.int64), np.frombuffer(lo), np.frombuffer(hi)
                box = held.setdefault(strip, [lo, hi, labels.min(), labels.max()])
                held[strip] = [np.minimum(box[0], lo), np.maximum(box[1], hi), min(box[2], labels.min()), max(box[3], labels.max())]
        yield _rows([(s, 0, 0, 0, b[2].tobytes(), b[3].tobytes(), None, b[0].tobytes(), b[1].tobytes()) for s, b in held.items()])

    found = pages.select("strip", "labels", "lo", "hi").repartition("strip").mapInArrow(bound, PAGES).collect()
    found = sorted(found, key=lambda r: r.strip)
    lo, hi = (np.array([np.frombuffer(r[c]) for r in found]).reshape(len(found), dims) for c in ("lo", "hi"))
    first, last = (np.array([np.frombuffer(r[c], np.int64)[0] for r in found], np.int64) for c in ("ids", "labels"))
    return np.array([r.strip for r in found], np.int32), Boxes(lo, hi, first, last)


def _nearest(anchors: DataFrame, pages: DataFrame, boxes: tuple, dims: int, lanes: int, k: int, same: bool) -> DataFrame:
    """(anchor, wish, rank, vec_id, score): for each window ``wishes[wish]`` of an anchor its ``k`` best rows."""
    anchors = anchors.withColumn("needs", F.col("wishes.lo"))
    first = write_shared(_search(anchors, pages, boxes, dims, lanes, k, same, True), "rtree-first")
    wished = anchors.select("anchor", F.posexplode("wishes").alias("wish", "window"))
    kth = _best(first, k).filter(F.col("rank") == k).select("anchor", "wish", F.col("score").alias("kth"))
    needs = wished.join(kth, ["anchor", "wish"], "left").groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct("wish", F.greatest("window.lo", "kth").alias("need")))).alias("list")
    ).select("anchor", F.col("list.need").alias("needs"))
    rest = _search(anchors.drop("needs").join(needs, "anchor"), pages, boxes, dims, lanes, k, same, False)
    return _best(first.unionByName(rest), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    listed = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score").cast("decimal(38,0)")).alias("down"), "vec_id", "score"))), 1, k)
    ranked = found.groupBy("anchor", "wish").agg(listed.alias("best")).select("anchor", "wish", F.posexplode("best").alias("at", "b"))
    return ranked.select("anchor", "wish", (F.col("at") + 1).alias("rank"), "b.vec_id", "b.score")


def _search(anchors: DataFrame, pages: DataFrame, boxes: tuple, dims: int, lanes: int, k: int, same: bool, first: bool) -> DataFrame:
    strips, tops = boxes

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each strip that an anchor has to search: of the first round the highest box, else all others that may count."""
        for batch in batches:
            out = []
            vectors = _matrix(batch.column("v"), dims)
            for at, (anchor, vec_id, label, wishes, needs) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("anchor", "vec_id", "label", "wishes", "needs")))):
                query = vectors[at]
                low, high = tops.intervals(query)
                slack = 1e-9 * (np.abs(low) + np.abs(high)) * (np.abs(high) >= EXACT)  # such sums round; strips look again exactly
                meets = np.zeros(len(strips), bool)
                for w in wishes:
                    meets |= (low - slack <= w["hi"]) & (high + slack >= w["lo"]) if w["hi"] >= w["lo"] else False
                meets &= tops.admits(label, same)
                if not meets.any():
                    continue
                best = int(np.argmax(np.where(meets, high, -np.inf)))
                if first:
                    chosen = [best]
                else:
                    may = np.zeros(len(strips), bool)
                    for w, need in zip(wishes, needs):
                        may |= (low - slack <= w["hi"]) & (high + slack >= need) if w["hi"] >= w["lo"] else False
                    may &= meets
                    may[best] = False
                    chosen = np.flatnonzero(may).tolist()
                windows = np.array([(w["lo"], w["hi"], need) for w, need in zip(wishes, needs)], np.int64).tobytes()
                own = np.array([vec_id, label], np.int64).tobytes()
                out += [(int(strips[s]), anchor % lanes, 1, anchor, own, windows, query.tobytes(), None, None) for s in chosen]
                if len(out) >= 4096:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, tree, out = None, [], None, []
        for batch in batches:
            for strip, lane, kind, key, ids, labels, data, _, _ in zip(*(c.to_pylist() for c in batch.columns)):
                if current != (strip, lane):
                    current, held, tree = (strip, lane), [], None
                if kind == 0:
                    held.append((np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), _large(data, len(ids) // 8, dims)))
                    continue
                if tree is None:
                    tree, held = Tree(held), []
                vec_id, label = np.frombuffer(ids, np.int64).tolist()
                windows = [tuple(w) for w in np.frombuffer(labels, np.int64).reshape(-1, 3).tolist()]
                for wish, best in enumerate(tree.nearest(np.frombuffer(data), vec_id, label, windows, k, same)):
                    out += [(key, wish, i, max(LOW, min(HIGH, int(score)))) for score, i in best]
            yield _found(out)
            out = []

    routed = anchors.select("anchor", "vec_id", "label", "v", "wishes", "needs").mapInArrow(route, PAGES)
    both = pages.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).unionByName(routed)
    return both.repartition("strip", "lane").sortWithinPartitions("strip", "lane", "kind", "key").mapInArrow(search, FOUND)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * 4
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["anchor", "wish", "vec_id", "score"])


def _whole(values: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in values.ravel()], dtype=object).reshape(values.shape)


class Tree:
    """One strip: pages, their nodes of 64 rows, and the rows."""

    def __init__(self, pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.pages = pages
        self.largest = max(np.abs(p[2]).max(initial=0) for p in pages)
        self.top = Boxes(*(np.array([f(p[c], axis=0) for p in pages]) for f, c in ((np.min, 2), (np.max, 2), (np.min, 1), (np.max, 1))))
        self.nodes = []
        for _, labels, data in pages:
            cuts = np.arange(0, len(data), NODE)
            self.nodes.append(Boxes(*(f.reduceat(x, cuts, axis=0) for f, x in ((np.minimum, data), (np.maximum, data), (np.minimum, labels), (np.maximum, labels)))))
        self.exact = None

    def whole(self) -> "Tree":
        """The same tree in whole numbers of any size."""
        if self.exact is None:
            self.exact = Tree.__new__(Tree)
            self.exact.pages = [(i, l, _whole(d)) for i, l, d in self.pages]
            self.exact.top, self.exact.nodes, self.exact.largest, self.exact.exact = self.top, self.nodes, 0, None
            for old in ("top", "nodes"):
                boxes = getattr(self, old)
                copy = [Boxes.__new__(Boxes) for _ in (boxes if old == "nodes" else [boxes])]
                for new, b in zip(copy, boxes if old == "nodes" else [boxes]):
                    new.corners, new.first, new.last = _whole(b.corners), b.first, b.last
                setattr(self.exact, old, copy if old == "nodes" else copy[0])
        return self.exact

    def nearest(self, query: np.ndarray, vec_id: int, label: int, windows: list[tuple[int, int, int]], k: int, same: bool) -> list[list]:
        """For each window (least, greatest, least that still helps) the ``k`` best (score, id) of rows in it."""
        if self.largest * np.abs(query).max(initial=0) * 2 * len(query) >= EXACT:
            return self.whole().nearest(_whole(query), vec_id, label, windows, k, same)
        best: list[list] = [[] for _ in windows]
        needs = [max(lo, need) if hi >= lo else HIGH + 1 for lo, hi, need in windows]  # an empty window needs the unreachable
        tops = [hi for _, hi, _ in windows]
        queue, count = [], 0

        def push(boxes: Boxes, page: int) -> None:
            nonlocal count
            low, high = boxes.intervals(query)
            least, widest = min(needs), max(tops)
            for at in np.flatnonzero(boxes.admits(label, same) & (high >= least) & (low <= widest)):
                count += 1
                heapq.heappush(queue, (-high[at], count, low[at], page, int(at)))

        push(self.top, -1)
        while queue:
            high, _, low, page, at = heapq.heappop(queue)
            if -high < min(needs):
                break
            if not any(-high >= need and low <= top for need, top in zip(needs, tops)):
                continue
            if page < 0:
                push(self.nodes[at], at)
                continue
            rows = slice(at * NODE, (at + 1) * NODE)
            ids, labels, data = (c[rows] for c in self.pages[page])
            scores = data @ query
            widest = (scores >= min(needs)) & (scores <= max(tops)) & ((labels == label) if same else (labels != label)) & (ids != vec_id)
            hits = [(scores[h], int(ids[h])) for h in np.flatnonzero(widest)]
            for j in range(len(windows)) if hits else ():
                inside = [hit for hit in hits if needs[j] <= hit[0] <= tops[j]]
                if inside:
                    best[j] = sorted(best[j] + inside, key=lambda x: (-x[0], x[1]))[:k]
                    if len(best[j]) == k:
                        needs[j] = max(needs[j], best[j][-1][0])
        return best
