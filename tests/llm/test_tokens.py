import random
import zlib

import numpy as np
import pytest

from codelode.llm import prefix_counts, tokens, wavelet

PATH = tokens.vocabulary_path()
ATOMS = [
    "a", "b", "the", " ", "  ", "\n", "'re", "'s", "é", "ß", "1", "²", "½", "日本", "!", "<|endoftext|>", "\t", "\x1c", "\x85", "\xa0",
    " loser", "x'll", "ª", "×", "ͅ", "ʰ", "_", "😀", "\x00", "\xad", "'", "r",
]
DOCS = "doc_id long, text string, shard int, n_tokens long"


@pytest.fixture(scope="module")
def library():
    enc = tokens.encoder(PATH)
    return lambda text: enc.tokenizer.encode(text, add_special_tokens=False).ids


def texts(seed, n, most=10):
    rng = random.Random(seed)
    return ["".join(rng.choices(ATOMS, k=rng.randint(0, most))) for _ in range(n)]


def test_encoder_equals_library(library):
    enc = tokens.Encoder(PATH, most=50)
    for text in texts(1, 3000):
        assert enc.ids(text).tolist() == library(text), text


def test_prefix_counts_equal_library(library):
    counter = prefix_counts.PrefixCounter(PATH, most=50)
    for text in texts(2, 600):
        assert counter.prefix_counts(text).tolist() == [len(library(text[:i])) for i in range(len(text) + 1)], text
        n = counter.count(text)
        assert n == len(library(text))
        for limit in range(5):
            assert len(library(text[: counter.fits(text, limit, n)])) <= limit


def test_letters_stand_for_bytes():
    text = "".join(map(chr, range(0x800))) + "日😀"
    assert tokens.letters(text) == text.encode().decode("latin-1").translate(tokens.BYTE_LETTERS)


def test_split_and_unsplit():
    rng = np.random.default_rng(5)
    for n in (0, 1, 9, 70_000):
        values, ones = rng.integers(0, 1 << 16, n).astype(np.uint16), rng.random(n) < 0.3
        parted = wavelet.split(values, ones)
        assert parted.tolist() == values[~ones].tolist() + values[ones].tolist()
        assert (wavelet.unsplit(parted, ones) == values).all()


def test_a_new_word_is_looked_up_once():
    """The table is asked by ``encode``; a part that is not in it goes to the model without asking again."""
    enc, asked = tokens.Encoder(PATH), []

    class Parts(dict):
        def get(self, key):
            asked.append(key)
            return dict.get(self, key)

    enc.parts = Parts()
    enc.encode("some words here")
    assert asked == [" some", "words", "here"]


def test_budget_cut():
    assert prefix_counts.budget_cut(np.array([0, 1, 1, 2, 3]), 2) == 3


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 3, 9) for i, t in rows], DOCS)


def test_token_counts(spark, library):
    rows = [(i, t) for i, t in enumerate(texts(3, 200, 30))] + [(None, "a b"), (3, None), (3, None), (7, "word " * 5000)]
    found = prefix_counts.token_counts(docs_of(spark, rows)).drop("fits_chars").collect()
    wanted = [(i, len((t or "").encode()), len(library(t or "")), len(library(t or "")) > 1024) for i, t in rows]
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)
    assert prefix_counts.token_counts(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("n,top", [(0, 5), (1, 1), (3000, 50257), (1537, 3), (512, 70000)])
def test_wavelet_matrix(n, top):
    ids = np.random.default_rng(n).integers(0, top, n)
    ids[: n // 3] = 0
    matrix = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, max(1, (top - 1).bit_length())).to_bytes())
    assert matrix.decode().tolist() == ids.tolist()
    for i in range(0, n, 97):
        assert matrix.access(i) == ids[i]
        assert matrix.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
        where = np.flatnonzero(ids == ids[i])
        assert matrix.count(int(ids[i])) == len(where)
        assert [matrix.select(int(ids[i]), k) for k in (0, len(where) - 1, len(where))] == [where[0], where[-1], -1]


def test_token_files(spark, library, tmp_path):
    rows = [(i * 7 % 201, t) for i, t in enumerate(texts(4, 201, 30))] + [(None, "a b"), (5, None), (5, None), (300, "word " * 3000)]
    path = f"file://{tmp_path}/ids"
    wavelet.write_token_files(docs_of(spark, rows), path, files=3, shard_tokens=500)
    found = wavelet.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    at, by_id = 0, {}
    for r in found:
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and r.ids[-1] == 2
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
        by_id.setdefault(r.doc_id, []).append(r.ids[:-1])
    wanted = {}
    for i, t in rows:
        wanted.setdefault(i, []).append(library(t or ""))
    assert {k: sorted(v) for k, v in by_id.items()} == {k: sorted(v) for k, v in wanted.items()}
    flat = [(r.start + k, r.doc_id) for r in found for k, x in enumerate(r.ids) if x == 64]
    assert sorted(map(tuple, wavelet.token_occurrences(spark, path, 64).collect())) == flat and flat


def test_token_files_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    wavelet.write_token_files(docs_of(spark, []), path, files=2)
    assert wavelet.read_token_files(spark, path).count() == 0


def test_access_opens_one_block_of_each_plane(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 64)
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 20_000), 999).astype(np.uint32)
    stored = wavelet.WaveletMatrix.encode(ids, 10)
    for i in (0, 7, 511, 512, 10_000, 19_999):
        matrix = wavelet.WaveletMatrix.from_bytes(stored)
        assert matrix.access(i) == ids[i] and all(p.opened <= 2 for p in matrix.planes) and sum(p.opened for p in matrix.planes) <= 12
        matrix = wavelet.WaveletMatrix.from_bytes(stored)
        assert matrix.rank(5, i) == (ids[:i] == 5).sum() and all(p.opened <= 2 for p in matrix.planes)
        matrix = wavelet.WaveletMatrix.from_bytes(stored)
        found = matrix.select(5, 100)
        assert found == np.flatnonzero(ids == 5)[100] and all(p.opened <= 6 for p in matrix.planes)
    assert (matrix.decode() == ids).all() and len(stored) < 4 * len(ids)
