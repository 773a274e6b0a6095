import random
import re
import zlib

import numpy as np
import pytest

from codelode.llm import toxicity

BAD = ["loserling", "scumball", "morontic", "trashette"]


def text(rng, bad=False, n=120):
    words = ["".join(rng.choices(["ta", "re", "on", "li", "wo", "ne"], k=rng.randint(1, 4))) for _ in range(n)]
    if bad:
        for _ in range(2):
            words[rng.randrange(n)] = rng.choice(BAD)[: rng.randint(6, 9)] + rng.choice(["", "s", "on"])
    return " ".join(words)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, i % 3 == 0), int(i % 3 == 0)) for i in range(600)]
    docs = [(i, t, "x", 0.5) for i, t, _ in rows] + [(None, "tare on", "x", 0.5), (700, None, "x", 0.5), (700, None, "x", 0.5), (701, "", "x", 0.5)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, held_out string, score double"),
        spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9000, 1), (2, None)], "doc_id long, toxic int"), rows,
    )


def test_held_out_rows_are_told_apart(tables):
    docs, labels, rows = tables
    model = toxicity.fit_toxicity(docs, labels, most_per_class=150)
    found = toxicity.score_documents(docs, model).collect()
    assert len(found) == 604
    truth = {i: y for i, _, y in rows}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.predicted == 0 for r in found if r.doc_id in (700, 701))
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in found)


def test_a_misspelling_shares_its_subwords():
    rng = random.Random(1)
    texts = [text(rng, i % 2 == 0) for i in range(300)]
    model = toxicity.train(texts, [int(i % 2 == 0) for i in range(300)])
    assert toxicity.text_logit(model, text(rng) + " loserlingo " + text(rng), {}) > 0 > toxicity.text_logit(model, text(rng), {})


def test_without_two_classes_the_prior_scores(spark, tables):
    docs, _, _ = tables
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_documents(docs, model).filter("predicted = 1").count() == 0
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_long_words_are_read_whole():
    """Words that differ only behind their first 64 characters, and runs of a script without spaces."""
    start = "x" * 64
    assert toxicity.text_words(start + "aaaa") != toxicity.text_words(start + "zzzzqq")
    word = "".join(chr(0x4E00 + i) for i in range(500))
    pieces = toxicity.text_words(word)
    assert all(any(word[i : i + 5] in p for p in pieces) for i in range(496)) and pieces[0] + "".join(p[4:] for p in pieces[1:]) == word
    assert toxicity.text_words("short words 12 stay") == ["short", "words", "0", "stay"]
    model = toxicity.SubwordModel(np.zeros(1 << 12, np.float32), -1.0, 8)
    model.weights[toxicity.subwords(toxicity.text_words(start + "zzzzqq")[1], 1 << 12)] = 9
    assert toxicity.text_logit(model, start + "zzzzqq", {}) > toxicity.text_logit(model, start + "aaaa", {})
    assert toxicity.text_logit(model, "y" * 1_000_000, {}) < 0


def test_scores_match_a_forward_pass_by_hand():
    """A text's score is the greatest mean, over eight words in a row, of the mean weight of each word's n-grams."""
    rng = np.random.default_rng(3)
    model = toxicity.SubwordModel(rng.normal(0, 1, 1 << 10).astype(np.float32), -0.3, 8)

    def by_hand(text):
        said = ["0" if w.isdigit() else w for w in re.findall(r"\w+", text.lower())]
        words = [w for i, w in enumerate(said) if i == 0 or said[i - 1] != w]
        values = []
        for w in words:
            marked = f"<{w}>"
            grams = [marked] + [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
            values.append(np.mean([model.weights[zlib.crc32(g.encode()) % 1024] for g in grams]))
        runs = [values[i : i + 8] for i in range(max(1, len(values) - 7))]
        return max(np.mean(r) for r in runs) + model.bias

    for text in ("One two, two three 44 four five six seven eight nine ten", "a", "The same the the END", "é ñ ü " * 20):
        assert abs(by_hand(text) - toxicity.text_logit(model, text, {})) < 1e-5
