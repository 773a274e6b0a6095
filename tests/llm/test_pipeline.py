import random
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.test_set_skipping import brute
from tests.llm.test_toxicity import text


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two classes of labelled texts, exact and near copies, and rows with nulls."""
    rng, rows, labels = random.Random(3), [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, text(rng, bad), "en", f"s{i % 4}", 1))
        labels.append((i, 1, int(bad)))
    clean = [r for r in rows if r[0] % 3]
    rows += [(1000 + i, clean[i][1], "en", "s1", 1) for i in range(20)]
    rows += [(2000 + i, clean[i + 30][1] + " extra", "en", None, 1) for i in range(20)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "s0", 1), (None, "unlike any other text here", "en", "s0", 1)]
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, inputs = docs.columns, docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, folder)
        assert made.columns == columns
        path = f"{folder}/out-{name.replace(' ', '-')}"
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        if name == "toxicity":
            gone = {r.doc_id for r in inputs} - {r.doc_id for r in rows}
            assert sum(i % 3 == 0 for i in range(300) if i in gone) > 90 and sum(bool(i % 3) for i in gone if i is not None and i < 300) < 12
        if name == "exact dedup":
            first = {}
            for r in inputs:
                if r.doc_id is not None:
                    first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(first.values())
        if name == "n-gram join":
            keep = {c for _, _, c in brute([(r.doc_id, r.text) for r in inputs])}
            assert {r.doc_id for r in rows} == keep and len(rows) == len(keep)
        if name == "mixing":
            assert max(Counter(r.doc_id for r in rows).values()) <= 2
        inputs = rows
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in inputs)


def test_it_is_registered_and_runs(spark, folder):
    assert "pipeline" in __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in __spark_entry__.queries() if q.startswith("op") and q[2].isdigit()}
    assert corpus_pipeline.run(spark, folder).count() > 0
