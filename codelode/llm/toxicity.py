"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from codelode.llm.memory import tidy

WORD = re.compile(r"\w+")
SIZES = (3, 4, 5)  # characters of the n-grams, the word's edges included
LONG = 64  # characters of a word; longer ones are cut


@dataclass
class SubwordModel:
    """What scoring needs of the trained network: per bucket the share of the logit, and the bias.

    Embeddings only enter the softmax through averages, so each bucket's vector times the difference of the two class
    vectors says all. A text's score is that of its most toxic run of ``window`` words.
    """

    weights: np.ndarray
    bias: float
    window: int

    def word_value(self, word: str) -> float:
        return float(self.weights[subwords(word, len(self.weights))].mean())


def subwords(word: str, buckets: int) -> list[int]:
    """Buckets of a word and of its character n-grams; unseen spellings share most of them with known ones."""
    word = f"<{word}>"
    grams = [word] + [word[i : i + n] for n in SIZES for i in range(len(word) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "replace")) % buckets for g in grams]


def text_words(text: str) -> list[str]:
    """Lower-cased words, all numbers being one word; a word said many times in a row counts once.

    Longer words, as runs of scripts that set no spaces, count as pieces of ``LONG`` characters; pieces overlap, so that no n-gram is lost.
    """
    words = [w for w, _ in groupby("0" if w.isdigit() else w for w in WORD.findall(text.lower()))]
    if len(max(words, key=len, default="")) <= LONG:
        return words
    step = LONG - SIZES[-1] + 1
    return [w[i : i + LONG] for w in words for i in range(0, max(1, len(w) - SIZES[-1] + 1), step)]


class _Bags:
    """Windows of words as flat arrays of buckets, for minibatches."""

    def __init__(self, texts: list[str], buckets: int):
        index: dict[str, int] = {}
        self.docs = [np.array([index.setdefault(w, len(index)) for w in text_words(t)], np.int32) for t in texts]
        lists = [subwords(w, buckets) for w in index]
        self.sizes = np.array([len(x) for x in lists], np.int32)
        self.starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.sizes, dtype=np.int64)))
        self.flat = np.fromiter((b for x in lists for b in x), np.int32, int(self.sizes.sum()))

    def rows(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words, and the word (position) that each belongs to."""
        sizes = self.sizes[words]
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.flat[self.starts[words][owner] + inside], owner


def train(
    texts: list[str], labels: list[int], buckets: int = 1 << 18, dim: int = 6, window: int = 8, rounds: int = 4, epochs: int = 3,
    rate: float = 0.5, seed: int = 11,
) -> SubwordModel:
    """Train embeddings and softmax together on a bounded list of labelled texts.

    Labels belong to texts, toxic words stand in a few places of them. So the first round learns from random windows
    under their text's label, and each further round from the window of every text that the model holds most toxic (for
    toxic texts the example, for clean ones the hardest counterexample) and random windows of clean texts.
    Adagrad steps on minibatches; everything is seeded.
    """
    rng = np.random.default_rng(seed)
    labels = np.array(labels, np.int64)
    if len(set(labels.tolist())) < 2:  # nothing to tell apart: the smoothed prior
        odds = (labels.sum() + 1) / (len(labels) - labels.sum() + 1)
        return SubwordModel(np.zeros(buckets, np.float32), float(np.log(odds)) if len(labels) else -1.0, window)
    bags = _Bags(texts, buckets)
    known = [i for i, d in enumerate(bags.docs) if len(d)]
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim))
    softmax, bias = rng.normal(0, 0.1, (dim, 2)), np.zeros(2)
    sums = [np.full(buckets, 1e-6), np.full((dim, 2), 1e-6), np.full(2, 1e-6)]
    for step in range(rounds + 1):
        if step == 0:
            chosen = [(i, w) for i in known for w in _random_windows(rng, bags.docs[i], 4 * window, 4)]
        else:
            value = vectors @ (softmax[:, 1] - softmax[:, 0])
            per_word = np.add.reduceat(value[bags.flat], bags.starts[:-1]) / bags.sizes
            chosen = [(i, _top_window(bags.docs[i], per_word, window)) for i in known]
            chosen += [(i, w) for i in known if labels[i] == 0 for w in _random_windows(rng, bags.docs[i], window, 4)]
        for _ in range(epochs if step else 2 * epochs):
            order = rng.permutation(len(chosen))
            for batch in np.array_split(order, max(1, len(order) // 512)):
                windows, y = [chosen[j][1] for j in batch], labels[[chosen[j][0] for j in batch]]
                flat, owner = bags.rows(np.concatenate(windows))
                bag_of_word = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
                share = 1 / (np.bincount(owner)[owner] * np.bincount(bag_of_word)[bag_of_word[owner]])
                bag = bag_of_word[owner]
                hidden = np.stack([np.bincount(bag, vectors[flat, k] * share, len(windows)) for k in range(dim)], axis=1)
                logits = hidden @ softmax + bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p *= np.where(y == 1, (y == 0).mean() + 0.1, (y == 1).mean() + 0.1)[:, None]
                back = p @ softmax.T
                touched, place = np.unique(flat, return_inverse=True)
                grads = np.stack([np.bincount(place, back[bag, k] * share, len(touched)) for k in range(dim)], axis=1)
                sums[0][touched] += (grads**2).mean(axis=1)
                vectors[touched] -= rate * grads / np.sqrt(sums[0][touched])[:, None]
                for parameter, grad, total in ((softmax, hidden.T @ p, sums[1]), (bias, p.sum(axis=0), sums[2])):
                    total += grad**2
                    parameter -= 0.2 * rate * grad / np.sqrt(total)
    weights = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
    model = SubwordModel(weights, float(bias[1] - bias[0]), window)
    model.bias += _shift(model, [texts[i] for i in known], labels[known])
    return model


def _random_windows(rng, doc: np.ndarray, size: int, n: int) -> list[np.ndarray]:
    return [doc[a : a + size] for a in rng.integers(0, max(1, len(doc) - size + 1), n)]


def _window_means(values: np.ndarray, size: int) -> np.ndarray:
    if len(values) <= size:
        return values.mean(keepdims=True)
    sums = np.concatenate((np.zeros(1), np.cumsum(values, dtype=np.float64)))
    return (sums[size:] - sums[:-size]) / size


def _top_window(doc: np.ndarray, per_word: np.ndarray, size: int) -> np.ndarray:
    at = int(np.argmax(_window_means(per_word[doc], size)))
    return doc[at : at + size]


def _shift(model: SubwordModel, texts: list[str], labels: np.ndarray) -> float:
    """Move the bias so that 0.5 lies in the middle between the two classes' text scores where they part best."""
    known: dict[str, float] = {}
    scores = np.array([text_logit(model, t, known) for t in texts])
    order = np.argsort(scores)
    ranked, y = scores[order], labels[order]
    wrong = np.concatenate(([np.sum(y == 0) * 1.0], np.sum(y == 0) - np.cumsum(y == 0) + np.cumsum(y == 1)))
    cuts = np.concatenate(([ranked[0] - 1], (ranked[:-1] + ranked[1:]) / 2, [ranked[-1] + 1]))
    best = np.flatnonzero(wrong == wrong.min())
    widths = [0 if i in (0, len(y)) else ranked[i] - ranked[i - 1] for i in best]
    return -float(cuts[best[int(np.argmax(widths))]])


def text_logit(model: SubwordModel, text: str, known: dict[str, float], most: int = 500_000) -> float:
    """The greatest window logit of a whole text; the bias alone where there is no word."""
    words = text_words(text)
    if not words:
        return min(model.bias, -1e-3)
    values = list(map(known.get, words))
    if None in values:
        for i, value in enumerate(values):
            if value is None:
                word = words[i]
                values[i] = value = known.get(word) or model.word_value(word)
                if len(known) < most:
                    known[word] = value
    return float(_window_means(np.array(values), model.window).max()) + model.bias


def toxicity_score(model: SubwordModel, text: Column) -> Column:
    """The probability (0 to 1) that a text is toxic; nulls count as empty."""

    @F.pandas_udf("double")
    @tidy
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in batches:
            logits = np.array([text_logit(model, t or "", known) for t in texts], np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -30, 30))))

    return score(F.coalesce(text, F.lit("")))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most_per_class: int = 3000, most_chars: int = 20_000,
) -> SubwordModel:
    """Train on a bounded sample of labelled rows outside the held-out fifth.

    At most ``most_per_class`` rows of each class, those with the smallest hash of their id, of texts of at most
    ``most_chars`` characters; the driver and the broadcast hold no more than that. Rows with null labels, other labels,
    null ids or null texts are no examples; an id with both labels counts as toxic. Without two classes the model is the prior.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(
        F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~is_held_out(F.col("_id"))
    ).groupBy("_id").agg(F.max("_y").alias("_y"))
    usable = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.length(text_col).alias("_n"))
    ids = usable.filter(F.col("_n").between(1, most_chars)).select("_id").join(known, "_id").distinct()
    order = F.xxhash64("_id"), F.col("_id")
    chosen = [ids.filter(F.col("_y") == y).orderBy(*order).limit(most_per_class) for y in (0, 1)]
    rows = usable.join(F.broadcast(chosen[0].union(chosen[1])), "_id").filter(F.col("_n").between(1, most_chars))
    rows = rows.groupBy("_id", "_y").agg(F.min("_text").alias("_text")).select("_id", "_y", "_text").collect()
    rows.sort(key=lambda r: r._id)
    return train([r._text for r in rows], [r._y for r in rows])


def score_documents(
    documents: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A map over the scan. Defined cases: a null text is empty and scores by the bias alone, below one half; null ids are
    not held out; repeated rows give a row each; an empty table gives no rows. Other columns never enter a score.
    """
    scored = documents.select(F.col(id_col).alias("doc_id"), toxicity_score(model, F.col(text_col)).alias("score"))
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def without_toxic(documents: DataFrame, model: SubwordModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that the model does not hold toxic, with all their columns."""
    return documents.filter(toxicity_score(model, F.col(text_col)) < threshold)
