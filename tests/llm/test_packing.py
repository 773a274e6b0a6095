import zlib

import numpy as np
import pytest

from codelode.llm import config_packing as packing, tokens


def check_plan(histogram, plan, capacity):
    held = np.zeros(capacity + 1, np.int64)
    for configuration, n in zip(plan.configurations, plan.counts):
        assert sum(configuration) <= capacity and n > 0
        for length in configuration:
            held[length] += n
    assert held.tolist() == histogram.tolist()
    assert sum(plan.counts) >= plan.lower_bound - 1e-6


@pytest.mark.parametrize("capacity,lengths,most", [
    (10, [5] * 7, 4), (10, [], 0), (10, [10, 10, 1], 3), (12, [6, 4, 2] * 50, 51), (100, list(range(1, 100)) * 20, 1010), (9, [5, 5, 5, 4, 4], 3),
])
def test_plans_cover_the_histogram(capacity, lengths, most):
    histogram = np.bincount(lengths, minlength=capacity + 1) if lengths else np.zeros(capacity + 1, np.int64)
    plan = packing.plan_configurations(histogram, capacity)
    check_plan(histogram, plan, capacity)
    assert sum(plan.counts) <= most


def test_program_beats_best_fit_where_it_can():
    rng = np.random.default_rng(5)
    histogram = np.bincount(rng.integers(200, 420, 100000), minlength=1025)
    plan = packing.plan_configurations(histogram, 1024)
    check_plan(histogram, plan, 1024)
    assert sum(plan.counts) < sum(packing.best_fit(histogram, 1024).values())


def test_knapsack_matches_brute_force():
    prices = np.array([0, 0, 0.3, 0.5, 0, 0.9, 0, 0])
    best = [0.0]
    for room in range(1, 8):
        best.append(max([best[room - 1]] + [prices[x] + best[room - x] for x in range(1, room + 1) if prices[x]]))
    knapsack = packing.Knapsack(prices, 7)
    assert np.allclose(knapsack.best, best)
    assert sum(prices[x] for x in knapsack.fill(7)) == pytest.approx(best[7])


def test_documents_are_packed_whole(spark):
    rows = [(i, "word " * (i * 37 % 400), 1) for i in range(60)] + [(None, "a b", 2), (5, None, 3), (5, None, 3), (99, "long text " * 900, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lane int")
    found = packing.pack_documents(docs, capacity=128).collect()
    enc, wanted = tokens.encoder(tokens.vocabulary_path()), []
    for doc, text, _ in rows:
        ids = [*enc.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 128 or 128
        cuts = [0, *range(first, len(ids), 128), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted.append((doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(wanted, key=str)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= sum(r.length for r in found) / 128 + 2


def test_packed_ids(spark):
    docs = spark.createDataFrame([(i, "w " * i) for i in range(30)], "doc_id long, text string")
    packed = packing.pack_documents(docs, capacity=64)
    ids = {r.sequence_id: r.ids for r in packing.packed_sequences(packed, docs).collect()}
    for r in packed.collect():
        part = ids[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
