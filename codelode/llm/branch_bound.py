"""Exact top-k search: columnar branch-and-bound over blocks of vertically stored vectors."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from codelode.sources.shared import write_shared

EXACT32, EXACT64 = float(1 << 24), float(1 << 53)
OUT = "query_id long, vec_id long, score long"


def scaled_components(embedding: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def top_inner_products(
    embeddings: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: float = 64.0, block: int = 4096, query_block: int = 16384, strips: int = 16,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` greatest inner products of floored components.

    Vectors are packed into blocks of rows, a binary column per block that holds them dimension by dimension. Every block of
    queries meets every block of candidates, dealt into ``strips`` for each query block; a task streams the blocks
    of its strip and keeps only its queries' current best. Inside a block, inner products accumulate over runs of
    dimensions, those with most query mass first; after each run, what the remaining dimensions can add at most (the
    product of the remaining norms) drops candidates that no query of a group can still need, and the survivors are compacted.
    The strips' best are merged at the end: at most ``strips * k`` rows a query.

    Ties go to the smaller id. Sums are exact: in 32-bit floats where all stay below 2**24, else in 64-bit ones below 2**53,
    else in integers; components and scores beyond 64 bits are cut to the nearest. Defined cases: vectors that are null or hold null or
    non-finite components take no part, nor do rows with a null id; shorter vectors count as if filled with zeros; rows
    that repeat an id are candidates each, and a query's own are those with its id; of query rows that repeat an id the one with the least vector,
    compared component by component, asks; fewer than ``k`` candidates
    give fewer rows; an empty table gives none. Other columns are ignored.
    """
    usable = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("is_query")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ).select("vec_id", scaled_components(F.col("v"), scale).alias("v"), F.coalesce("is_query", F.lit(False)).alias("is_query"))
    usable = write_shared(usable, "topk-vectors")
    n = usable.agg(F.count("*").alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("q")).first()
    blocks, query_blocks = -(-n.n // block) or 1, -(-n.q // query_block) or 1
    candidates = _pack(usable, blocks).withColumns({
        "strip": (F.col("block") % strips), "group": F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))), "kind": F.lit(1)
    })
    asking = usable.filter("is_query").groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = _pack(asking, query_blocks).withColumns({
        "group": F.col("block"), "strip": F.explode(F.sequence(F.lit(0), F.lit(min(strips, blocks) - 1))), "kind": F.lit(0)
    })
    both = queries.unionByName(candidates).repartition("group", "strip").sortWithinPartitions("group", "strip", "kind", "block")
    found = both.select("group", "strip", "kind", "ids", "dims", "data").mapInArrow(_search(k), OUT)
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score")))
    ranked = found.groupBy("query_id").agg(F.slice(best, 1, k).alias("best")).select("query_id", F.posexplode("best").alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", "b.score")


def _pack(vectors: DataFrame, blocks: int) -> DataFrame:
    """Blocks of about equal size, by a hash of the id: (block, ids, dims, data), data being dims x rows of doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        current = None
        for batch in batches:
            for b, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if current is not None and b != current:
                    yield _block(current, held.pop(current))
                current = b
                held.setdefault(b, []).append((i, v.values.to_numpy()))
        if current is not None:
            yield _block(current, held.pop(current))

    dealt = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")
    dealt = dealt.repartition("block").sortWithinPartitions("block", "vec_id")
    return dealt.mapInArrow(pack, "block int, ids binary, dims int, data binary")


def _block(number: int, rows: list) -> pa.RecordBatch:
    dims = max(len(v) for _, v in rows)
    data = np.zeros((dims, len(rows)))
    for at, (_, v) in enumerate(rows):
        data[: len(v), at] = v
    ids = np.array([i for i, _ in rows], np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int32()), pa.array([ids.tobytes()]), pa.array([dims], pa.int32()), pa.array([data.tobytes()])],
        names=["block", "ids", "dims", "data"],
    )


class _Best:
    """The best k (score, id) of each query of a block so far; ``floor`` is what a candidate must reach."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = np.full(n, -np.inf)

    def offer(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate((self.scores[query], scores))
        ids = np.concatenate((self.ids[query], ids))
        if len(scores) > 4 * self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = scores >= cut
            scores, ids = scores[keep], ids[keep]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[query], self.ids[query] = scores[order], ids[order]
        self.floor[query] = self.scores[query, -1]


def search_block(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, best: _Best, run: int = 16, group: int = 64) -> None:
    """Offer a block of candidates (dims x rows) to all queries (rows x dims), in groups of queries."""
    dims = max(queries.shape[1], data.shape[0])
    queries = np.pad(queries, ((0, 0), (0, dims - queries.shape[1])))
    data = np.pad(data, ((0, dims - data.shape[0]), (0, 0)))
    top = float(np.sqrt((queries**2).sum(axis=1)).max(initial=0) * np.sqrt((data**2).sum(axis=0)).max(initial=0))
    if top >= EXACT64 / 2:
        _search_integers(queries, query_ids, data, ids, best)
        return
    kind = np.float32 if top < EXACT32 / 2 and max(np.abs(queries).max(initial=0), np.abs(data).max(initial=0)) < EXACT32 else np.float64
    order = np.argsort(-(queries**2).sum(axis=0), kind="stable")
    queries, data = queries[:, order].astype(kind), data[order].astype(kind)
    runs = [slice(a, a + run) for a in range(0, dims, run)]
    square = data.astype(np.float64) ** 2
    after = [np.sqrt(square[r.stop :].sum(axis=0)) for r in runs]
    for a in range(0, len(queries), group):
        part, floor = queries[a : a + group], best.floor[a : a + group]
        squares = part.astype(np.float64) ** 2
        alive = np.arange(len(ids))
        sums = np.zeros((len(part), len(ids)), kind)
        for r, rest in zip(runs, after):
            sums += part[:, r] @ data[r, alive]
            room = np.sqrt(squares[:, r.stop :].sum(axis=1))
            # an upper bound, widened a little against rounding; equal scores may still win by a smaller id
            hope = sums + (room[:, None] * rest[alive][None, :] * (1 + 1e-6) + 1e-6)
            live = (hope >= floor[:, None]).any(axis=0)
            if live.mean() < 0.9:
                alive, sums = alive[live], sums[:, live]
            if not len(alive):
                break
        for q in range(len(part)):
            at = np.flatnonzero((sums[q] >= floor[q]) & (ids[alive] != query_ids[a + q]))
            if len(at):
                best.offer(a + q, sums[q, at].astype(np.float64), ids[alive[at]])


def _search_integers(queries, query_ids, data, ids, best: _Best) -> None:
    """For components so large that floating sums would round: whole numbers, cut to 64 bits."""
    columns = [[int(x) for x in data[:, j]] for j in range(data.shape[1])]
    for q, query in enumerate(queries):
        own = [int(x) for x in query]
        for j, column in enumerate(columns):
            if ids[j] != query_ids[q]:
                score = sum(x * y for x, y in zip(own, column))
                best.big.setdefault(q, []).append((-max(-(2**63), min(2**63 - 1, score)), int(ids[j])))
        best.big[q] = sorted(best.big.get(q, []))[: best.k]


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, queries, query_ids, best = None, None, None, None
        for batch in batches:
            for row in range(len(batch)):
                group, strip, kind, ids, dims, data = (c[row].as_py() for c in batch.columns)
                ids = np.frombuffer(ids, np.int64)
                data = np.frombuffer(data).reshape(dims, len(ids))
                if kind == 0:
                    if best is not None:
                        yield from _emit(query_ids, best)
                    current, queries, query_ids, best = (group, strip), np.ascontiguousarray(data.T), ids, _Best(len(ids), k)
                    best.big = {}
                elif current == (group, strip):
                    search_block(queries, query_ids, data, ids, best)
        if best is not None:
            yield from _emit(query_ids, best)

    return search


def _emit(query_ids: np.ndarray, best: _Best) -> Iterator[pa.RecordBatch]:
    at, place = np.nonzero(best.scores > -np.inf)
    rows = [query_ids[at], best.ids[at, place], best.scores[at, place].astype(np.int64)]
    for q, found in best.big.items():
        rows = [np.append(c, x) for c, x in zip(rows, (
            [query_ids[q]] * len(found), np.array([i for _, i in found], np.int64), np.array([-s for s, _ in found], np.int64)))]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["query_id", "vec_id", "score"])
