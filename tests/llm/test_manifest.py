"""The Merkle manifest against a tree built by hand."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from codelode.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, digest string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def tree(digests, fanout):
    """The root, and for each leaf what stands before and after it, level by level."""
    paths, level, owners = [[] for _ in digests], list(digests), [[i] for i in range(len(digests))]
    while len(level) > 1:
        runs = [slice(a, a + fanout) for a in range(0, len(level), fanout)]
        for run in runs:
            for j, own in enumerate(owners[run]):
                for i in own:
                    paths[i].append(("".join(level[run][:j]), "".join(level[run][j + 1 :])))
        level, owners = [sha("".join(level[run])) for run in runs], [sum(owners[run], []) for run in runs]
    return level[0], paths


def brute(rows, changed, fanout=3):
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r), leaf(changed(r)))):
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    lower = {s: tree([leaf(r) for r in by[s]], fanout) for s in names}
    root, upper = tree([lower[s][0] for s in names], fanout)
    out = []
    for name, above in zip(names, upper):
        for r, own in zip(by[name], lower[name][1]):
            node = leaf(changed(r))
            for before, after in own + above:
                node = sha(before + node + after)
            out.append((r[0], leaf(r), lower[name][0], root, sha("".join(b + a for b, a in own + above)), node, node == root))
    return sorted(out, key=str)


def without_feeds(row):
    return (*row[:4], row[4].replace("\n", "")) if row[4] is not None and row[0] is not None and row[0] % 2 else row[:5]


def tampered(documents):
    return {"text": F.when(documents["doc_id"] % 2 == 1, F.translate(documents["text"], "\n", "")).otherwise(documents["text"])}


ROWS = [(i, f"s{i % 3}" if i % 11 else "hot", "en", i, f"a\nline {i}") for i in range(70)] + [
    (100, None, None, None, None), (101, None, "de", 2, ""), (None, "s1", "en", 1, "x"), (None, "hot", "en", 1, "y\n"), (None, "hot", "en", 1, "x"),
    (7, "s1", "en", 7, "a\nline 7"), (7, "s1", "en", 7, "a\nline 7"), (7, "s1", "en", 7, "another"), (200, "", "en", 1, "e"), (201, "é", "en", 1, "\n" * 5),
    (203, "Z", "en", 3, "long " * 100_000 + "\n"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r[:5], "t", 4, "d") for r in rows], DOCS)


@pytest.mark.parametrize("fanout", [2, 3, 7])
def test_manifest_matches_a_tree_built_by_hand(spark, fanout):
    found = merkle.verified_documents(frame(spark, ROWS), tampered, fanout).collect()
    assert sorted(map(tuple, found), key=str) == brute(ROWS, without_feeds, fanout)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_trees_of_every_shape(spark, n):
    rows = [(i, "only", "en", i, str(i)) for i in range(n)]
    found = merkle.verified_documents(frame(spark, rows)).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, lambda r: r)


def test_tampering_shows_and_repeated_rows_spread(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RUN", 8)
    rows = [(None, "hot", None, None, None)] * 300 + [(1, "hot", "en", 1, "a\nb")]
    found = merkle.verified_documents(frame(spark, rows), tampered).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows, without_feeds)
    assert [r.doc_id for r in found if not r.verified] == [1]


def test_manifest_of_nothing(spark):
    assert merkle.verified_documents(frame(spark, []), tampered).collect() == []


def test_registered_query(spark, tmp_path):
    frame(spark, ROWS).drop("tree", "pos", "digest").write.parquet(f"{tmp_path}/documents.parquet")

    def changed(row):
        return (*row[:4], row[4].replace("\n", "")) if row[4] is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 else row[:5]

    found = __spark_entry__.queries()["op11_merkle"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=str) == brute(ROWS, changed)
