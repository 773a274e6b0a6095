"""Runs of three bytes of texts, and which of them a pattern cannot match without.

Texts and patterns are folded alike: A-Z lower-cased, and the four other letters that match an ASCII letter when case is
ignored put as that letter. Only ASCII runs of a pattern count, so the rest of Unicode needs no rule.
"""

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# workers get this module's functions by value, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIZE = 3
LONG = 8  # bytes of the runs that long codes stand for
SHORT_CODES, LONG_BITS, SHARED = 1 << 8 * SIZE, 30, 5  # codes of long runs follow those of three bytes; 2**5 of them share a place
PLACES = SHORT_CODES + (1 << LONG_BITS - SHARED)  # of a set of codes
ALIKE = str.maketrans("\u0131\u0130\u017f\u212a", "iisk")  # fixed values: dotless i, dotted I, long s, Kelvin sign
ALIKE_LETTERS = [chr(c) for c in ALIKE]
PIECE = 1 << 22
PAIRS = 1 << 21  # grams of texts that are held at once
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fold_text(text: str) -> bytes:
    """The folded text in UTF-8."""
    if not text.isascii() and any(c in text for c in ALIKE_LETTERS):  # looking for four letters costs far less than a translation
        text = text.translate(ALIKE)
    return _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].tobytes()


def text_grams(text: str) -> np.ndarray:
    """The distinct grams of a text as sorted 24-bit numbers; whole texts of any length, a piece of them at a time."""
    data, found = np.frombuffer(fold_text(text), np.uint8), None
    for at in range(0, max(1, len(data) - SIZE + 1), PIECE):
        part = data[at : at + PIECE + SIZE - 1].astype(np.int32)
        codes = np.unique((part[:-2] << 16) | (part[1:-1] << 8) | part[2:]) if len(part) >= SIZE else np.zeros(0, np.int32)
        found = codes if found is None else np.union1d(found, codes)
    return found


def _long_codes(data: np.ndarray) -> np.ndarray:
    """A code for each run of eight bytes, in order; different runs may share one."""
    two = (data[:-1].astype(np.uint64) << np.uint64(8)) | data[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    eight = (four[:-4] << np.uint64(32)) | four[4:]
    eight *= np.uint64(0x9E3779B97F4A7C15)
    return (eight >> np.uint64(64 - LONG_BITS)).astype(np.int32) + np.int32(SHORT_CODES)


def wanted_grams(text: str, wanted: np.ndarray) -> np.ndarray:
    """The distinct codes of a text's grams, short and long, whose place in ``wanted`` is true, sorted; a piece of the text at a time."""
    data, found = np.frombuffer(fold_text(text), np.uint8), []
    for at in range(0, max(1, len(data) - SIZE + 1), PIECE):
        part = data[at : at + PIECE + LONG - 1]
        if len(part) >= SIZE:
            wide = part.astype(np.int32)
            codes = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
            found.append(codes[wanted[codes]])
        if len(part) >= LONG:
            codes = _long_codes(part)
            found.append(codes[wanted[SHORT_CODES + (codes - SHORT_CODES >> SHARED)]])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def run_grams(run: str, size: int = SIZE) -> list[int]:
    """The grams of a fixed ASCII run, in order; those of size ``LONG`` by the codes of ``wanted_grams``."""
    data = fold_text(run)
    if size == LONG:
        return _long_codes(np.frombuffer(data, np.uint8)).tolist() if len(data) >= LONG else []
    return [int.from_bytes(data[i : i + SIZE], "big") for i in range(len(data) - SIZE + 1)]


def required(pattern: str, size: int = SIZE):
    """What a text must hold to match: a gram, ("and", parts), ("or", parts), or None where nothing is certain.

    Fixed runs between other syntax give their grams; branches give a choice, unless one of them asks for nothing.
    """
    if "(?" in re.sub(r"\\.|\(\?:|\(\?P<", "", pattern):
        return None  # flags and assertions: not read here
    return _all(_parts(re._parser.parse(pattern), size))


def _all(parts: list):
    parts = [p for p in dict.fromkeys(parts) if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _parts(sequence, size: int) -> list:
    """Conditions that all hold for a sequence of the standard library's parsed patterns."""
    found, run = [], ""

    def close():
        nonlocal run
        found.extend(run_grams(run, size))
        run = ""

    for kind, value in sequence:
        name = str(kind)
        if name == "LITERAL" and value < 128:
            run += chr(value)
            continue
        close()
        if name == "SUBPATTERN":
            found += _parts(value[-1], size)
        elif name == "ATOMIC_GROUP":
            found += _parts(value, size)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            found += _parts(value[2], size)
        elif name == "BRANCH":
            choices = [_all(_parts(branch, size)) for branch in value[1]]
            if all(c is not None for c in choices):
                found.append(("or", tuple(dict.fromkeys(choices))))
    close()
    return found


def gram_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For batches of (bucket, id, text): each gram with the ids of a run of texts of one bucket that hold it."""
    codes, ids, held, bucket = [], [], 0, None

    def made():
        grams, numbers = np.concatenate(codes), np.concatenate(ids)
        order = np.lexsort((numbers, grams))
        grams, numbers = grams[order], numbers[order]
        first = np.flatnonzero(np.diff(grams, prepend=grams[0] - 1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(grams)).astype(np.int32)), pa.array(numbers))
        return pa.RecordBatch.from_arrays([pa.array(grams[first]), pa.array(np.full(len(first), bucket, np.int32)), lists], names=["gram", "bucket", "ids"])

    for batch in batches:
        for at, number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            found = text_grams(text.as_py() or "").astype(np.int32)
            if held and (at != bucket or held + len(found) > PAIRS):
                yield made()
                codes, ids, held = [], [], 0
            bucket, held = at, held + len(found)
            if len(found):
                codes.append(found)
                ids.append(np.full(len(found), number, np.int32))
    if held:
        yield made()
