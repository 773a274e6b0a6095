import random
import re

import pytest
from pyspark.sql import functions as F

from codelode.llm import set_skipping

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    width = min(5, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[find(i)] = min(smallest.get(find(i), doc), doc)
    return sorted(((doc, len(s), smallest.get(find(i), doc)) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n=260):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    line = rng.choices(words, k=30)
    texts = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.6:  # near copies, chains of near copies, copies
            new = rng.choice(texts[-40:] if kind < 0.3 else texts[:5]).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                if new:
                    new[rng.randrange(len(new))] = rng.choice(words)
            if rng.random() < 0.3:
                new = new[: max(1, len(new) - rng.randint(0, 8))]
        else:
            new = rng.choices(words, k=rng.choice([1, 3, 4, 5, 6, 30, 80, 200])) + (line if rng.random() < 0.5 else [])
        texts.append(" ".join(new))
    return texts


@pytest.fixture
def docs(spark):
    return lambda rows: spark.createDataFrame([(*r, 2, "k") for r in rows], "doc_id long, text string, n int, key string")


@pytest.mark.parametrize("seed,known,span", [(1, 1 << 16, 1 << 20), (2, 0, 300), (3, 20, 40), (4, 20, 1 << 20)])
def test_components_match_brute_force(docs, monkeypatch, seed, known, span):
    monkeypatch.setattr(set_skipping, "KNOWN", known)
    for name in ("LANE", "SPAN", "STEP"):
        monkeypatch.setattr(set_skipping, name, span)
    rng = random.Random(seed)
    texts = corpus(seed)
    ids = rng.sample(range(10000), len(texts))
    rows = list(zip(ids, texts)) + [(None, texts[3]), (None, "lonely text of its own here now"), (20000, None), (20001, " \n"), (20002, "A b C"), (20003, "a B c")]
    rows += [(20004, texts[7])] * 2 + [(20005, "x\x1cy z")]
    found = set_skipping.near_duplicates(docs(rows)).drop("text_hash").collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_one_document_of_each_group_stays(docs):
    rows = [(i * 3 % 1009, t) for i, t in enumerate(corpus(5, 120))]
    rows += [(2000, "one two three four five six")] * 2 + [(2001, None), (2002, "")]
    kept = set_skipping.without_near_duplicates(docs(rows))
    assert kept.columns == ["doc_id", "text", "n", "key"]
    wanted = {c for _, _, c in brute(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(wanted)


def test_a_large_group_makes_few_pairs(spark, docs):
    rng = random.Random(8)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(600):
        new = list(base)
        new[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(new)))
    found = set_skipping.near_duplicates(docs(rows))
    assert found.filter("component_id = 0").count() == 600


def loose_group(n, seed=9, words=100):
    """Near copies of a base that are often too far from each other, and texts that share a passage only."""
    rng = random.Random(seed)
    base, passage = [f"v{i}" for i in range(words)], [f"p{i}" for i in range(30)]
    rows = []
    for i in range(n):
        new = list(base)
        for j in range(rng.choice([1, 2, 2, 3, 4])):
            new[rng.randrange(words)] = f"x{i}y{j}"
        rows.append((2 * i, " ".join(new)))
        own = [f"o{i}z{j}" for j in range(rng.randint(20, 60))]
        rows.append((2 * i + 1, " ".join(own[:10] + passage + own[10:])))
    return rows


def test_a_loose_group_is_answered_without_pairs(spark, docs, monkeypatch):
    """What the steps write grows with the group, not with its square; and the links are those of brute force."""
    written = {}
    real = set_skipping.Scratch.write

    def count(self, df, name):
        out = real(self, df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(set_skipping.Scratch, "write", count)
    counts = []
    for n in (100, 400):
        written.clear()
        rows = loose_group(n)
        found = set_skipping.near_duplicates(docs(rows)).drop("text_hash").collect()
        assert sorted(map(tuple, found), key=str) == brute(rows)
        counts.append(dict(written))
    for name in ("across", "links-within", "diffs"):
        assert counts[1][name] <= 6 * counts[0][name] + 50, (name, counts)
    assert counts[1]["across"] < 400


def test_very_long_and_very_equal_texts(docs, monkeypatch):
    monkeypatch.setattr(set_skipping, "SPAN", 5000)
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [(1, long), (2, long + " tail"), (3, "l1 " * 50_000), (4, "l1 " * 40_000), (5, "x" * 200_000), (6, "x" * 200_000 + " y")]
    found = set_skipping.near_duplicates(docs(rows + [(9, "same few words here now")] * 40)).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 9: 9} and len(found) == 46


def test_nothing_is_left_behind(spark, docs):
    import os

    from codelode.sources.shared import shared_folder

    set_skipping.near_duplicates(docs([(i, t) for i, t in enumerate(corpus(7, 60))])).collect()
    newest = max((os.path.join(shared_folder(spark), f) for f in os.listdir(shared_folder(spark)) if f.startswith("ngram-")), key=os.path.getmtime)
    assert sorted(f.rsplit("-", 1)[0] for f in os.listdir(newest)) == ["components", "documents"]


def test_join_of_nothing(docs):
    assert set_skipping.near_duplicates(docs([])).count() == 0
    assert set_skipping.near_duplicates(docs([(1, "a"), (2, "b")])).filter(F.col("doc_id") == F.col("component_id")).count() == 2
