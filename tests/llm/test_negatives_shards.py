"""Hard negatives and sharding against brute force."""

import random
import zlib
from collections import Counter
from math import floor

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from codelode.llm import rtree, sharding

VECTORS = "vec_id long, embedding array<double>, label int, anchor int, wish int, v string"


def brute_negatives(rows, anchor=lambda i: i % 5 == 0, positives=5, negatives=3, low=50, high=95, scale=256):
    def good(r):
        return None not in r[:3] and all(x is not None and abs(x) < float("inf") for x in r[1])

    rows = [(i, [floor(scale * x) for x in v], label) for i, v, label, *_ in filter(good, rows)]
    out = []
    for i, v, label in rows:
        if not anchor(i):
            continue
        others = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for j, w, m in rows if j != i)
        for p, j, m in [o for o in others if o[2] == label][:positives]:
            inside = [(k, n) for n, k, m in others if m != label and low * -p <= 100 * -n <= high * -p]
            out += [(i, j, at + 1, k, -p, -n) for at, (k, n) in enumerate(inside[:negatives])]
    return sorted(out)


def vectors(n, dims=6, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, 0.6) for x in centres[i % 5]], rng.choice([0, 0, 0, 1, 2, 9])) for i in range(n)]


SPECIAL = [
    (1000, [float("nan")] * 6, 1), (1005, [None, 1.0], 1), (1010, None, 1), (1015, [1.0], None), (None, [1.0] * 6, 1), (1020, [], 0), (1025, [0.5, 0.5], 0),
    (1030, [float("inf"), 0.0], 0), (1035, [0.0] * 6, 2), (5, [1.0, -1.0, 0.5, 0.5, 0.5, 0.5], 1), (5, [1.0, -1.0, 0.5, 0.5, 0.5, 0.5], 1), (7, [3.0] * 6, 1),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, 4, "x") for r in rows], VECTORS)


@pytest.mark.parametrize("strip_rows", [None, 40, 7])
def test_negatives_match_brute_force(spark, strip_rows):
    rows = vectors(240) + SPECIAL
    random.Random(4).shuffle(rows)
    found = rtree.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0, strip_rows=strip_rows).collect()
    assert sorted(map(tuple, found)) == brute_negatives(rows)
    assert len(found) > 100


def test_small_pages_nodes_and_lanes(spark, monkeypatch):
    for name, value in (("PAGE", 8), ("NODE", 3), ("BATCH", 4), ("SAMPLE", 30)):
        monkeypatch.setattr(rtree, name, value)
    rows = vectors(300, 4, 2)
    found = rtree.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0, positives=3, negatives=4, low=10, high=100, strip_rows=50).collect()
    assert sorted(map(tuple, found)) == brute_negatives(rows, positives=3, negatives=4, low=10, high=100)


def test_ties_go_to_smaller_ids_and_huge_numbers_stay_exact(spark):
    rows = [(i, [0.25, 0.5], i % 2) for i in range(30)]
    found = rtree.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0, high=100).collect()
    assert sorted(map(tuple, found)) == brute_negatives(rows, high=100)
    huge = [(i, [2.0**17 * (i + 1), 3.0 + i], i % 2) for i in range(12)]
    found = rtree.hard_negatives(frame(spark, huge), F.col("vec_id") % 5 == 0, scale=2.0**10).collect()
    assert sorted(map(tuple, found)) == brute_negatives(huge, scale=2**10)


def test_one_vector_for_a_third_of_all_rows(spark):
    rows = [(i, [0.5, 0.5, 0.1], 1) for i in range(100)] + vectors(200, 3)
    found = rtree.hard_negatives(frame(spark, rows), F.col("vec_id") % 25 == 0, strip_rows=40).collect()
    assert sorted(map(tuple, found)) == brute_negatives(rows, lambda i: i % 25 == 0)


def test_long_vectors_and_nothing(spark):
    long = [(i, [((i * 7 + d) % 11 - 5) / 5 for d in range(3000)], i % 3) for i in range(20)]
    found = rtree.hard_negatives(frame(spark, long), F.col("vec_id") % 5 == 0).collect()
    assert sorted(map(tuple, found)) == brute_negatives(long)
    assert rtree.hard_negatives(frame(spark, []), F.col("vec_id") % 5 == 0).collect() == []
    assert rtree.hard_negatives(frame(spark, vectors(30)), F.lit(False)).collect() == []


def test_registered_negatives(spark, tmp_path):
    rows = vectors(400)
    frame(spark, rows).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    found = __spark_entry__.queries()["op12_rtree"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == brute_negatives(moved, lambda i: i % 50 == 0)


# --- sharding ----------------------------------------------------------------------------------------------------------------------------


DOCS = "doc_id long, text string, shard int, slot long, version int, digest string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "d") for r in rows], DOCS)


def texts(n):
    rng = random.Random(n)
    return [(i, "é" * rng.randint(0, 60) + str(i)) for i in range(n)]


ODD = [(None, None)] * 40 + [(None, "x")] * 3 + [(5, "same")] * 30 + [(6, ""), (6, None), (7, "long " * 50_000)]


def test_places_are_gapless_and_bytes_near_equal(spark):
    rows = texts(3000)
    found = sharding.place(documents(spark, rows), 10, 512).collect()
    by, size = {}, Counter()
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
        size[r.shard] += r["size"]
    assert sorted(by) == list(range(10)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 10
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in found) == [(i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in rows]
    assert {(r.law, r.grown_shard) for r in found} == {("bytes", None)}


def test_odd_rows_and_small_pieces(spark):
    rows = texts(200) + ODD
    for piece in (100_000, 2):
        found = sharding.place(documents(spark, rows), 4, 64, piece=piece).collect()
        want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == want
        for shard in range(4):
            own = sorted(r.slot for r in found if r.shard == shard)
            assert own == list(range(len(own)))
    assert len({r.shard for r in found if r.doc_id == 5}) > 1  # a row that repeats is spread
    again = sharding.place(documents(spark, rows[::-1]).repartition(3), 4, 64, piece=2).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_no_documents(spark):
    assert sharding.place(documents(spark, []), 4, 64).collect() == []


def held(table, version=None):
    return {r.slot: r.shard for r in table.at(version).collect()}


def test_the_map_is_versioned_and_edited(spark, tmp_path):
    table = sharding.new_map(spark, 64, 4, str(tmp_path / "map"))
    weights = spark.createDataFrame([(s, 1 + 50 * (s % 4 == 0) + s % 5) for s in range(60)], "slot int, bytes long")
    first = held(table)
    assert first == {s: s % 4 for s in range(64)}
    weight = {r.slot: r.bytes for r in weights.collect()}

    def loads(shards):
        out = Counter({s: 0 for s in set(shards.values())})
        for slot, shard in shards.items():
            out[shard] += weight.get(slot, 0)
        return out

    even = held(sharding.rebalance(table, weights))
    assert max(loads(even).values()) - min(loads(even).values()) <= 51
    assert held(table, 0) == first
    before = table.version
    grown = held(sharding.grow(table, weights))
    assert {grown[s] for s in grown if grown[s] != even[s]} == {4}
    assert abs(loads(grown)[4] - sum(weight.values()) / 5) < 60
    assert held(table, before) == even
    # rows follow the map they are given
    rows = texts(300)
    placed = sharding.place(documents(spark, rows), table=table, slots=64).collect()
    assert all(r.shard == grown[r.virtual] for r in placed)
    with pytest.raises(ValueError):
        sharding.new_map(spark, 8, 9)


def test_shards_are_written_whole(spark, tmp_path):
    rows = texts(120) + ODD
    docs = documents(spark, rows)
    placed = sharding.place(docs, 3, 32)
    back = sharding.write_shards(docs, placed, str(tmp_path / "shards"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows)
    assert Counter((r.shard, r.slot, r.doc_id) for r in back.collect()) == Counter((r.shard, r.slot, r.doc_id) for r in placed.collect())


def test_registered_sharding(spark, tmp_path):
    documents(spark, texts(500)).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    found = __spark_entry__.queries()["op13_virtual_slots"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert {r.shard for r in found.collect()} == set(range(40))
