"""Token-ID output: a wavelet matrix per shard, with rank and select on compressed bit-planes."""

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from codelode.llm.tokens import encoder, vocabulary_path

BLOCK = 8192  # bytes of a plane that are compressed together
MAGIC = b"WMX2"
SHARDS = "part int, shard int, doc_ids array<long>, ends array<long>, n_tokens long, planes binary"
_CODEC = pa.Codec("zstd", compression_level=1)


def split(values: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The values where the bit is zero, then those where it is one, each in order; by positions, which cost a third of masks."""
    return np.concatenate((values.take(np.flatnonzero(~ones)), values.take(np.flatnonzero(ones))))


def unsplit(values: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """What ``split`` made the values of."""
    at, up = np.flatnonzero(~ones), np.empty_like(values)
    up[at] = values[: len(at)]
    up[np.flatnonzero(ones)] = values[len(at) :]
    return up


class Plane:
    """The bits of one level in compressed blocks, with the number of ones before each; a block is opened when it is asked for."""

    def __init__(self, n: int, ranks: np.ndarray, offsets: np.ndarray, data: memoryview):
        self.n, self.ranks, self.offsets, self.data = n, ranks, offsets, data
        self.zeros = n - int(ranks[-1])
        self.opened, self._at, self._block = 0, -1, None

    @staticmethod
    def pack(ones: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """(ones before each block and in all, the blocks) of a plane's booleans."""
        packed = np.packbits(ones)
        cuts = range(0, max(1, len(packed)), BLOCK)
        blocks = [packed[a : a + BLOCK] for a in cuts]
        counts = [int(np.bitwise_count(b).sum()) for b in blocks]
        return np.concatenate((np.zeros(1, np.int64), np.cumsum(counts))), [_CODEC.compress(b.tobytes(), asbytes=True) for b in blocks]

    def block(self, at: int) -> np.ndarray:
        """The packed bytes of a block; the last one stays open."""
        if at != self._at:
            size = min(BLOCK, -(-self.n // 8) - at * BLOCK)
            raw = _CODEC.decompress(self.data[self.offsets[at] : self.offsets[at + 1]], size)
            self._at, self._block, self.opened = at, np.frombuffer(raw, np.uint8), self.opened + 1
        return self._block

    def bits(self) -> np.ndarray:
        """All bits as booleans."""
        blocks = [self.block(i) for i in range(len(self.ranks) - 1)] if self.n else []
        return np.unpackbits(np.concatenate(blocks), count=self.n).view(bool) if blocks else np.zeros(0, bool)

    def bit(self, i: int) -> int:
        return int(self.block(i // (8 * BLOCK))[i // 8 % BLOCK] >> (7 - i % 8) & 1)

    def ones(self, i: int) -> int:
        """Ones among the first i bits."""
        at, inside = divmod(i, 8 * BLOCK)
        if not inside:
            return int(self.ranks[at])
        block = self.block(at)
        found = int(np.bitwise_count(block[: inside // 8]).sum())
        if inside % 8:
            found += int(block[inside // 8] >> (8 - inside % 8)).bit_count()
        return int(self.ranks[at]) + found

    def select(self, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one or zero."""
        before = self.ranks if bit else np.minimum(np.arange(len(self.ranks), dtype=np.int64) * 8 * BLOCK, self.n) - self.ranks
        at = int(np.searchsorted(before, k, side="right")) - 1
        start = at * 8 * BLOCK
        part = np.unpackbits(self.block(at), count=min(8 * BLOCK, self.n - start))
        return start + int(np.flatnonzero(part == bit)[k - int(before[at])])


class WaveletMatrix:
    """A sequence of ids below 2**bits as bit-planes, the highest bit first.

    Each plane keeps the order that a stable split by all higher bits gives. Access, rank and select open one block of each plane, or
    the two at the ends of a range; ranks at block starts are stored.
    """

    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes, self.bits = n, planes, len(planes)

    @staticmethod
    def encode(ids: np.ndarray, bits: int | None = None) -> bytes:
        """Magic, length, plane count; for each plane its ranks and block ends; then all blocks."""
        bits = bits or max(1, int(ids.max(initial=0)).bit_length())
        values = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        heads, blocks = [], []
        for k in range(bits - 1, -1, -1):
            ones = (values >> values.dtype.type(k) & values.dtype.type(1)).astype(np.uint8).view(bool)
            ranks, packed = Plane.pack(ones)
            heads += [ranks.astype("<i8").tobytes(), np.cumsum([0, *map(len, packed)]).astype("<i8").tobytes()]
            blocks += packed
            values = split(values, ones)
        return MAGIC + struct.pack("<QI", len(ids), bits) + b"".join(heads) + b"".join(blocks)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> "WaveletMatrix":
        return cls.from_bytes(cls.encode(ids, bits))

    @classmethod
    def from_bytes(cls, data: bytes) -> "WaveletMatrix":
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, bits = struct.unpack_from("<QI", data, 4)
        entries = max(1, -(-n // (8 * BLOCK))) + 1
        tables = np.frombuffer(data, "<i8", 2 * bits * entries, 16).reshape(bits, 2, entries)
        data, at, planes = memoryview(data), 16 + 16 * bits * entries, []
        for ranks, ends in tables:
            planes.append(Plane(n, ranks, ends, data[at : at + int(ends[-1])]))
            at += int(ends[-1])
        matrix = cls(n, planes)
        matrix.raw = data.obj
        return matrix

    def to_bytes(self) -> bytes:
        return self.raw

    def decode(self) -> np.ndarray:
        """The whole sequence: the splits are undone from the lowest plane up."""
        values = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k, plane in enumerate(reversed(self.planes)):
            ones = plane.bits()
            values[plane.zeros :] |= values.dtype.type(1 << k)
            values = unsplit(values, ones)
        return values

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for plane in self.planes:
            bit, ones = plane.bit(i), plane.ones(i)
            i = plane.zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, token: int, i: int) -> int:
        """Occurrences of an id among the first i."""
        if not 0 <= token < 1 << self.bits:
            return 0
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of occurrence k (from 0) of an id; -1 if there are fewer."""
        if k < 0 or k >= self.count(token):
            return -1
        i = self._range(token, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit, plane = token >> (self.bits - 1 - level) & 1, self.planes[level]
            i = plane.select(bit, i - plane.zeros if bit else i)
        return i

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for level, plane in enumerate(self.planes):
            one_lo, one_hi = plane.ones(lo), plane.ones(hi)
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = plane.zeros + one_lo, plane.zeros + one_hi
            else:
                lo, hi = lo - one_lo, hi - one_hi
        return lo, hi


def write_token_files(
    documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
    vocabulary: str | None = None, files: int | None = None, shard_tokens: int = 1 << 21,
) -> None:
    """Encode every whole text, append ``end_id``, and write the ids in ascending order of document ids.

    Documents are range-partitioned by id and sorted; each task writes one file of consecutive shards. A shard holds whole
    documents, closes at ``shard_tokens`` tokens, and is one compressed wavelet matrix beside its document ids and their
    ends, so a task holds one shard at a time. Files are Parquet in any store that Spark writes, and a lost task's file is
    written anew. ``part`` and ``shard`` give the global order.

    Defined cases: a null text is empty and has the end id alone; null document ids come first; rows that repeat an id
    follow each other by text; an empty table gives no shards. Other columns are ignored.
    """
    vocab = vocabulary or vocabulary_path()
    files = files or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocab), end_id.to_bytes(4, "little")
        bits = max(enc.tokenizer.get_vocab_size() - 1, end_id).bit_length()
        ids, held, docs, ends, shard = [], 0, [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = np.frombuffer(enc.encode(text) + end, "<u4").astype(np.uint16 if bits <= 16 else np.uint32)
                ids.append(found)
                held += len(found)
                docs.append(doc)
                ends.append(held)
                if held >= shard_tokens:
                    yield _shard(batch.column(0)[0].as_py(), shard, ids, docs, ends, bits)
                    ids, held, docs, ends, shard = [], 0, [], [], shard + 1
        if docs:
            yield _shard(batch.column(0)[0].as_py(), shard, ids, docs, ends, bits)

    parts = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    parts.mapInArrow(encode, SHARDS).write.option("compression", "uncompressed").parquet(path)


def _shard(part, shard, ids, docs, ends, bits) -> pa.RecordBatch:
    whole = np.concatenate(ids)
    return pa.RecordBatch.from_arrays([
        pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([docs], pa.list_(pa.int64())),
        pa.array([ends], pa.list_(pa.int64())), pa.array([len(whole)], pa.int64()), pa.array([WaveletMatrix.encode(whole, bits)], pa.binary()),
    ], names=["part", "shard", "doc_ids", "ends", "n_tokens", "planes"])


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, start): tokens before each shard, summed over files first and then inside each."""
    shards = spark.read.parquet(path).select("part", "shard", "n_tokens")
    files = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = files.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return shards.join(files, "part").select("part", "shard", (F.col("base") + F.col("inside")).alias("start"))


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, and the ids if wanted."""
    shards = spark.read.parquet(path).drop("n_tokens").join(_starts(spark, path), ["part", "shard"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                docs, ends, planes, start = (batch.column(i)[row] for i in range(4))
                ids = WaveletMatrix.from_bytes(planes.as_py()).decode().astype("<u4")
                ends = ends.values.to_numpy()
                starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, ends)]
                columns = [docs.values, pa.array(starts + start.as_py()), pa.array(ends - starts), pa.array(crc, pa.int64())]
                if with_ids:
                    offsets = pa.array(np.concatenate((starts, ends[-1:])), pa.int32())
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return shards.select("doc_ids", "ends", "planes", "start").mapInArrow(decode, schema)


def token_occurrences(spark: SparkSession, path: str, token: int, most_per_shard: int | None = None) -> DataFrame:
    """(position, doc_id) of an id in the whole output, by select on each shard's planes."""
    shards = spark.read.parquet(path).drop("n_tokens").join(_starts(spark, path), ["part", "shard"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                docs, ends, planes, start = (batch.column(i)[row].as_py() for i in range(4))
                matrix = WaveletMatrix.from_bytes(planes)
                found = matrix.count(token)
                at = [matrix.select(token, k) for k in range(min(found, most_per_shard or found))]
                doc = [docs[i] for i in np.searchsorted(ends, at, side="right")]
                yield pa.RecordBatch.from_arrays([pa.array([start + i for i in at], pa.int64()), pa.array(doc, pa.int64())], names=["position", "doc_id"])

    return shards.select("doc_ids", "ends", "planes", "start").mapInArrow(find, "position long, doc_id long")
