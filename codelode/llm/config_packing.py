"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights."""

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codelode.llm.tokens import encoder, vocabulary_path
from codelode.sources.shared import write_shared

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


@dataclass
class Plan:
    """How many sequences get each configuration: rows of (configuration, count), a configuration being item lengths."""

    configurations: list[tuple[int, ...]]
    counts: list[int]
    lower_bound: float  # no packing needs fewer sequences (from the program's dual)


class Knapsack:
    """Dynamic program over the room of one sequence: the greatest total price of lengths that fit, repeats allowed."""

    def __init__(self, prices: np.ndarray, capacity: int):
        self.best, self.choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int32)
        lengths = np.flatnonzero(prices)
        gain, fits = prices[lengths], np.searchsorted(lengths, np.arange(capacity + 1), side="right")
        for room in range(1, capacity + 1):
            self.best[room] = self.best[room - 1]
            if fits[room]:
                value = gain[: fits[room]] + self.best[room - lengths[: fits[room]]]
                top = int(value.argmax())
                if value[top] > self.best[room] + 1e-12:
                    self.best[room], self.choice[room] = value[top], lengths[top]

    def fill(self, room: int) -> list[int]:
        """The lengths of the best filling of ``room``."""
        found = []
        while room > 0:
            length = int(self.choice[room])
            if length:
                found.append(length)
            room -= length or 1
        return found


def solve_program(need: np.ndarray, capacity: int, weights: np.ndarray, upto: float, step: float, rate: float, slack: float):
    """A fractional solution by multiplicative weights: ({configuration: amount}, final weights, lower bound).

    A round prices the lengths by their weights, solves the knapsack, and takes for every length the best
    configuration that it leads, if that is worth at least ``1 - slack`` of the best one; a length is covered by at most
    ``step`` of its need in a round. Then weights grow for lengths that lag behind the mean cover and shrink for those ahead.
    Prices over the best value are feasible for the dual program, so each round also proves a lower bound.
    """
    live, covered = np.flatnonzero(need), np.zeros(len(need))
    amounts: dict[tuple[int, ...], float] = {}
    bound, mass = 0.0, float(np.dot(np.arange(len(need)), need))
    for _ in range(int(8 / step)):
        knapsack = Knapsack(weights, capacity)
        bound = max(bound, float(np.dot(weights, need)) / knapsack.best[capacity])
        value = weights[live] + knapsack.best[capacity - live]
        quota = np.minimum(step * need, np.maximum(need - covered, 0))
        for length in live[np.argsort(-value, kind="stable")]:
            if weights[length] + knapsack.best[capacity - length] < (1 - slack) * knapsack.best[capacity]:
                break
            if quota[length] <= 1e-9 * need[length]:
                continue
            configuration = tuple(sorted([int(length), *knapsack.fill(capacity - length)], reverse=True))
            uses = Counter(configuration)
            amount = min(quota[x] / n for x, n in uses.items())
            if amount > 1e-9:
                amounts[configuration] = amounts.get(configuration, 0.0) + amount
                for x, n in uses.items():
                    quota[x] -= amount * n
                    covered[x] += amount * n
        share = covered[live] / need[live]
        mean = float(np.dot(covered, np.arange(len(need)))) / mass
        if mean >= upto:
            break
        weights = weights.copy()
        weights[live] *= np.exp(rate * (mean - share))
    return amounts, weights, bound


def plan_configurations(histogram: np.ndarray, capacity: int) -> Plan:
    """Cover a histogram of lengths (index: length up to ``capacity``) by configurations, as few as the program allows.

    A first pass of multiplicative weights only learns the prices, from prices in proportion to length; a second starts at
    the learned ones and gives the amounts. They are rounded down, and what is left is packed best-fit, longest first,
    in groups of equal sequences. The work depends on the capacity alone, not on the number of items.
    """
    need = histogram.astype(np.float64)
    start = np.where(need > 0, np.arange(capacity + 1) / capacity, 0.0)
    bound, counts, rest = float(np.dot(np.arange(capacity + 1), need)) / capacity, {}, histogram.copy()
    if need.sum() > 0:
        _, learned, first = solve_program(need, capacity, start, 0.9, 0.1, 1.0, 0.02)
        amounts, _, second = solve_program(need, capacity, learned, 0.97, 0.05, 1.0, 0.02)
        bound = max(bound, first, second)
        counts = {c: int(x + 1e-6) for c, x in amounts.items() if int(x + 1e-6)}
    for c, n in counts.items():
        for length in c:
            rest[length] -= n
    counts |= {c: counts.get(c, 0) + n for c, n in best_fit(rest, capacity).items()}
    return Plan(list(counts), list(counts.values()), bound)


def best_fit(histogram: np.ndarray, capacity: int) -> dict[tuple[int, ...], int]:
    """Best-fit, longest first, over groups of equal sequences: {configuration: count}."""
    groups: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for length in np.flatnonzero(histogram)[::-1].tolist():
        left = int(histogram[length])
        for room in range(length, capacity + 1):
            each = room // length
            source = [((), -(-left // each))] if room == capacity else list(groups[room].items())
            for items, there in source:
                full = min(there, left // each)
                part = left - full * each if there > full and left - full * each < each else 0
                for n, bins in ((each, full), (part, 1)):
                    if n and bins:
                        target = groups[room - n * length]
                        key = items + (length,) * n
                        target[key] = target.get(key, 0) + bins
                        left -= n * bins
                        if room < capacity:
                            groups[room][items] -= bins
                if room < capacity and not groups[room][items]:
                    del groups[room][items]
                if not left:
                    break
            if not left:
                break
    return {items: n for rooms in groups for items, n in rooms.items()}


def cut_pieces(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2,
    vocabulary: str | None = None,
) -> DataFrame:
    """Pieces of every document's ids: doc_id, piece, start, length, ids_crc32.

    Ids are the library's for the whole text, and ``end_id``. Documents of at most ``capacity`` ids are one piece; only longer
    ones are cut, into pieces of ``capacity`` behind a first piece of what is left over.
    """
    vocab = vocabulary or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocab), end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = memoryview(enc.encode(text or "") + end)
                n, at, piece = len(data) // 4, 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    crc = zlib.crc32(data[4 * at : 4 * (at + size)])
                    rows.append((doc, piece, at, size, crc))
                    at, piece = at + size, piece + 1
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return documents.select(F.col(id_col).cast("long"), text_col).mapInArrow(cut, PIECES)


def pack_documents(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2,
    vocabulary: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are encoded once, in the scan, without a shuffle. The histogram of piece lengths has at most ``capacity`` entries and
    is all that the driver sees; its plan says which sequences hold which lengths. Pieces of one length are numbered
    inside (length, lane) groups, a lane being a hash of document and piece, and sums per lane give each group its base,
    so a length that many pieces share is spread. The number then names the sequence and the offset, by a search in the
    plan's table, whose size depends on the capacity alone.

    Defined cases: a null text is empty and is a piece of the end id alone; null and repeated ids give pieces
    each; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    lanes = max(256, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = cut_pieces(documents, id_col, text_col, capacity, end_id, vocabulary)
    pieces = write_shared(pieces.withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(lanes)).cast("int")), "packing-pieces")
    sizes = pieces.groupBy("length", "lane").agg(F.count("*").alias("n"))
    sizes = write_shared(sizes, "packing-sizes")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in sizes.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        histogram[length] = n
    plan = plan_configurations(histogram, capacity)
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    here = Window.partitionBy("length", "lane").orderBy("doc_id", "piece", "ids_crc32")
    numbered = pieces.withColumn("at", F.row_number().over(here) - 1).join(bases, ["length", "lane"])
    table = _slots(plan, capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for value in np.unique(length):
                rows = np.flatnonzero(length == value)
                starts, first, uses, at = table[int(value)]
                slot = np.searchsorted(starts, number[rows], side="right") - 1
                inside = number[rows] - starts[slot]
                sequence[rows] = first[slot] + inside // uses[slot]
                offset[rows] = at[slot] + inside % uses[slot] * value
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], batch.column(3).cast(pa.int64()), batch.column(4), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("at")).alias("number")).mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def _slots(plan: Plan, capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first item number, first sequence, uses per sequence and offset, for each configuration with it."""
    found: dict[int, list] = {}
    taken = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for configuration, count in zip(plan.configurations, plan.counts):
        offset = 0
        for length in dict.fromkeys(configuration):
            uses = configuration.count(length)
            found.setdefault(length, []).append((taken[length], sequence, uses, offset))
            taken[length] += count * uses
            offset += uses * length
        sequence += count
    return {length: tuple(np.array(c, np.int64) for c in zip(*rows)) for length, rows in found.items()}


def packed_sequences(
    packed: DataFrame, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, vocabulary: str | None = None
) -> DataFrame:
    """(sequence_id, ids): the packed ids themselves, for documents with unique ids; a sequence is bounded by its capacity."""
    vocab = vocabulary or vocabulary_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for batch in batches:
            ids = [[*enc.ids(t or "").tolist(), end_id] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "all_ids"])

    ids = documents.select(F.col(id_col).cast("long"), text_col).mapInArrow(encode, "doc_id long, all_ids array<int>")
    parts = packed.join(ids, "doc_id").select(
        "sequence_id", "offset", F.slice("all_ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids")
    )
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
