"""Words and word-shingle sets of whole texts as arrays, for use inside Arrow batches.

A word is a run of bytes other than 0x20 and 0x09-0x0D in UTF-8, with A-Z lower-cased. All work is on the bytes of a
whole batch at once, so it costs a few nanoseconds a byte.
"""

import numpy as np
import pyarrow as pa

WIDTH = 5
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 2**64))
_SYMBOLS = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_SYMBOLS[65:91] = _SYMBOLS[97:123]
_PLACES = np.random.default_rng(21).integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)
PIECE = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, size: int) -> np.ndarray:
    if len(_powers.get(name, ())) < size:
        table = np.full(size, base)
        table[0] = 1
        _powers[name] = np.multiply.accumulate(table)
    return _powers[name][:size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 ends of its texts; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word of one text."""
    out, n, at = [], len(data), 0
    while at < n:
        stop = min(n, at + PIECE)
        if stop < n:  # end a piece at a space, or take the word that spans it whole
            gap = np.flatnonzero(SPACE[data[stop:]][: 1 << 16])
            rest = gap[0] if len(gap) else np.append(np.flatnonzero(SPACE[data[stop:]]), n - stop)[0]
            stop += int(rest)
        part = data[at:stop]
        edge = np.diff(np.concatenate(([True], SPACE[part], [True])).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_SYMBOLS[part] * _power(_ODD, "up", len(part)))))
        out.append(mix((sums[end] - sums[start]) * _power(_INVERSE, "down", len(part) + 1)[start] + (end - start).astype(np.uint64)))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(data: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of one text; with fewer words, of the whole sequence."""
    words = word_hashes(data)
    if len(words) == 0:
        return words
    width = min(WIDTH, len(words))
    last = len(words) - width + 1
    hashes = np.full(last, np.uint64(width))
    for i in range(width):
        hashes += words[i : i + last] * _PLACES[i]
    return np.unique(mix(hashes))


def shingle_sets(texts: pa.Array):
    """The shingle set of each text of a batch, one after the other."""
    data, ends = text_bytes(texts)
    for start, end in zip(ends[:-1], ends[1:]):
        yield shingle_set(data[start:end])
