import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.llm import branch_bound, cube_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped, out = share * sum(sizes.values()), set(), {}
    while True:
        free = sum(weight[s] for s in names if s not in capped)
        left = total - sum(most * sizes[s] for s in capped)
        out = {s: most * sizes[s] if s in capped else left * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and out[s] > most * sizes[s]}
        if not over:
            return out
        capped |= over


def mix_rows():
    rng = random.Random(2)
    rows = []
    for i in range(900):
        source = rng.choice(["a", "a", "a", "B", "é", "z", None, "tiny"]) if i % 50 else "tiny"
        rows.append((i, " ".join(["w"] * rng.randint(1, 60)), source))
    return rows + [(None, "x y", "a"), (901, None, "a"), (902, "", None), (903, "x\x0by\x1cz", "q")] + [(904, "same text", "B")] * 3


@pytest.fixture
def mix_docs(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, 5) for r in rows], "doc_id long, text string, source string, size int, chunk int")


def test_mix_meets_its_targets(mix_docs):
    rows = mix_rows()
    found = cube_mix.mix_sources(mix_docs(rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = targets(sizes)
    assert sorted(((r.doc_id, r.size, r.source) for r in found), key=str) == sorted(((i, len(WORD.findall(t or "")), s) for i, t, s in rows), key=str)
    for source in sizes:
        own = [r for r in found if r.source == source]
        assert {r.source_size for r in own} == {sizes[source]}
        assert all(abs(r.target - want[source]) < 1e-6 * max(1, want[source]) for r in own)
        assert abs(sum(r.taken for r in own) - want[source]) <= (2 if len(own) > 20 else 60)
        assert all(r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in own)
    again = cube_mix.mix_sources(mix_docs(rows[::-1]).repartition(5)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, found), key=str)


def test_mix_over_chunks(mix_docs, monkeypatch):
    monkeypatch.setattr(cube_mix, "CHUNK", 32)
    rows = mix_rows()
    found = cube_mix.mix_sources(mix_docs(rows)).collect()
    assert len(found) == len(rows)
    for source in {r.source for r in found}:
        own = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 12


def test_mix_is_materialised(mix_docs):
    docs = mix_docs(mix_rows())
    mixed = cube_mix.mix_sources(docs)
    made = cube_mix.materialise(docs, mixed)
    assert made.columns == docs.columns
    assert made.agg(F.sum(cube_mix.word_count(F.col("text")))).first()[0] == mixed.agg(F.sum("taken")).first()[0]


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(3)
    sizes, shares = sorted(rng.integers(1, 500, 400).astype(float), reverse=True), [0.3] * 400
    moved = cube_mix.flight(sizes, shares, random.Random(1))
    assert sum(0 < m < 1 for m in moved) <= 2
    assert abs(sum(moved) - 120) < 1e-6 and abs(np.dot(sizes, moved) - 0.3 * sum(sizes)) < 1e-4


def test_mix_of_nothing(mix_docs):
    assert cube_mix.mix_sources(mix_docs([])).count() == 0


def brute_top(rows, k):
    def usable(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v)

    points = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = []
    for q in {i for i, _ in points if i % 20 == 0}:
        own = next(v for i, v in points if i == q)
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(own, v)))), i) for i, v in points if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("case", ["plain", "ties", "large", "huge", "few"])
def test_top_k_matches_brute_force(spark, case):
    rng = np.random.default_rng(7)
    n, dims = {"few": (5, 8), "huge": (60, 5)}.get(case, (400, 24))
    scale = {"large": 3e6, "huge": 1e12}.get(case, 0.2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, scale, dims)]) for i in range(n)]
    if case == "ties":
        rows = [(i, [0.5] * 3 if i % 3 else [0.25, -0.5]) for i in range(200)] + [(7, [0.5] * 3)] * 2
        rows += [(None, [0.1]), (900, None), (920, [float("nan"), 1.0]), (940, [1.0, None]), (960, []), (961, [float("inf")])]
    table = spark.createDataFrame([(*r, 4, "x") for r in rows], "vec_id long, embedding array<double>, block int, kind string")
    found = branch_bound.top_inner_products(table, F.col("vec_id") % 20 == 0, block=64, query_block=7, strips=3)
    assert sorted(map(tuple, found.collect())) == brute_top(rows, 20)


def test_top_k_of_nothing(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert branch_bound.top_inner_products(table, F.col("vec_id") % 20 == 0).count() == 0


def test_many_equal_rows_are_dealt_over_chunks(spark, mix_docs, monkeypatch):
    monkeypatch.setattr(cube_mix, "CHUNK", 32)
    sizes = []
    real = cube_mix._flights

    def watched(rows, seed, level):
        sizes.append(max([r["count"] for r in rows.groupBy("source", "chunk").count().collect()], default=0))
        return real(rows, seed, level)

    monkeypatch.setattr(cube_mix, "_flights", watched)
    rows = [(None, None, "a")] * 400 + [(7, "same few words", "a")] * 400 + [(i, "w " * (i % 9), "b") for i in range(100)]
    found = cube_mix.mix_sources(mix_docs(rows)).collect()
    assert len(found) == 900 and max(sizes) <= 3 * 32
    again = cube_mix.mix_sources(mix_docs(rows[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, found), key=str)


def test_a_query_id_with_two_vectors_is_answered_alike_in_any_order(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.2]), (2, [0.1, 1.0]), (3, [0.5, 0.4])]
    answers = []
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(3)
        answers.append(sorted(map(tuple, branch_bound.top_inner_products(table, F.col("vec_id") % 20 == 0, 3).collect())))
    assert answers[0] == answers[1] and [r[2] for r in answers[0]] == [2, 3, 1]


def test_vectors_of_many_dimensions(spark):
    rows = [(i, [((i * 5 + d) % 9 - 4) / 4 for d in range(4000)]) for i in range(25)]
    found = branch_bound.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 4).collect()
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    for q in (0, 20):
        best = sorted((-sum(x * y for x, y in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:4]
        assert [(r.vec_id, r.score) for r in sorted(found) if r.query_id == q] == [(i, -s) for s, i in best]
