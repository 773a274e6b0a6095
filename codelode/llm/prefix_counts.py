"""Token counts: a dynamic program over byte prefixes gives the exact count of every prefix."""

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codelode.llm.tokens import BYTE_LETTERS, LAST, PIECES, SIMPLE, encoder, vocabulary_path

OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long"


class PrefixCounter:
    """Exact token counts of texts and of all their prefixes, for a byte-level BPE vocabulary.

    Within a piece, the encoding of a prefix is the encoding of a shorter prefix and one last token: of the vocabulary's
    strings that end there, the one whose pair with the shorter prefix's last token the model leaves as it is. So one
    pass over the bytes stores the last token and the count of each prefix, and longer prefixes reuse the shorter ones.
    Counts of a text are sums over its pieces; a cut inside a run of white space counts the run up to the cut as one
    piece, as the tokenizer does at the end of a text.
    """

    def __init__(self, path: str, most: int = 800_000):
        self.encoder = encoder(path)
        self.model = self.encoder.model
        to_byte = {c: b for b, c in BYTE_LETTERS.items()}
        special = set(self.encoder.special)
        self.vocabulary = {
            bytes(to_byte.get(c, ord(c)) for c in token): i
            for token, i in self.encoder.tokenizer.get_vocab(with_added_tokens=False).items() if token not in special
        }
        self.strings = {i: s for s, i in self.vocabulary.items()}
        self.longest = max(map(len, self.vocabulary))
        self.most, self.pairs, self.counts, self.pieces = most, {}, {}, {}

    def _ids(self, data: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(data.decode("latin-1").translate(BYTE_LETTERS))]

    def _stays(self, last: int, token: int) -> bool:
        """Whether the model leaves two tokens beside each other as they are; last is -1 at the start."""
        whole = self.strings[token] if last < 0 else self.strings[last] + self.strings[token]
        found = self._ids(whole) == ([token] if last < 0 else [last, token])
        if len(self.pairs) < self.most:
            self.pairs[last, token] = found
        return found

    def piece_counts(self, data: bytes) -> list[int]:
        """Token counts of the prefixes of 1, 2, ... bytes of one piece."""
        last, count, vocabulary = [-1], [0], self.vocabulary
        pairs, longest = self.pairs, self.longest
        for end in range(1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = vocabulary.get(data[start:end])
                if token is None:
                    continue
                stays = pairs.get((last[start], token))
                if stays or stays is None and self._stays(last[start], token):
                    last.append(token)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError(f"no token ends a prefix of {data[:end]!r}: not a byte-level BPE vocabulary")
        return count[1:]

    def piece(self, piece: str) -> int:
        found = self.pieces.get(piece)
        if found is None:
            found = self.piece_counts(piece.encode())[-1]
            if len(self.pieces) < self.most // 4 and len(piece) < 64:
                self.pieces[piece] = found
        return found

    def word(self, word: str) -> int:
        """The count of a space and simple letters."""
        found = self.counts.get(word)
        return self._keep(word, self.piece_counts((" " + word).encode())[-1]) if found is None else found

    def _segments(self, text: str) -> list[str]:
        """Texts between special strings and the special strings themselves, in order."""
        parts = [text]
        for s in self.encoder.special:
            parts = [y for x in parts for y in (_split_keep(x, s) if x not in self.encoder.special else [x])]
        return parts

    def split(self, text: str) -> Iterator[str]:
        """The pieces that the tokenizer would split a text into, special strings being pieces of their own."""
        for part in self._segments(text):
            if part in self.encoder.special:
                yield part
            elif part and SIMPLE.fullmatch(part):
                yield from (m[0] for m in PIECES.finditer(part))
            elif part:
                tokenizer = self.encoder.tokenizer.pre_tokenizer
                yield from (part[a:b] for _, (a, b) in tokenizer.pre_tokenize_str(part))

    def count(self, text: str) -> int:
        """Tokens of a whole text, from the stored counts of its parts."""
        parts = text.split(" ")
        parts[0] = " " + parts[0]  # marks the first part, which has no space before it
        found = list(map(self.counts.get, parts))
        if None in found:
            for i, known in enumerate(found):
                if known is None:
                    found[i] = self._part(parts[i])
                    if found[i] is None:
                        return sum(1 if p in self.encoder.special else self.piece(p) for p in self.split(text))
        return sum(found)

    def _part(self, part: str) -> int | None:
        """The count of a part with the space before it; None where parts do not split safely."""
        if not part or part == " ":
            return None
        simple = max(part) < LAST
        if simple and part.isalpha():
            return self.word(part)
        if simple and part[-1] in ".,;:!?" and part[:-1].isalpha():
            return self._keep(part, self.word(part[:-1]) + self.piece(part[-1]))
        if part[-1].isspace() or part[0].isspace() and part[0] != " " or not SIMPLE.fullmatch(part):
            return None
        if any(s in part for s in self.encoder.special):
            return None
        return self._keep(part, sum(map(self.piece, PIECES.findall(part[1:] if part[0] == " " else " " + part))))

    def _keep(self, part: str, count: int) -> int:
        if len(self.counts) < self.most and len(part) < 64:
            self.counts[part] = count
        return count

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of the prefixes of 0, 1, ... characters: entry i belongs to ``text[:i]``."""
        out = [0]
        done = 0  # tokens before the current piece
        run, run_before = 0, 0  # characters and tokens before the white space that the prefix ends with
        plain, plain_before = 0, 0  # the same for the text since the last special string
        for piece in self.split(text):
            if piece in self.encoder.special:
                before = text[plain : len(out) - 1]
                for i in range(1, len(piece)):
                    out.append(plain_before + sum(map(self.piece, self.split(before + piece[:i]))))
                done += 1
                out.append(done)
                run = plain = len(out) - 1
                run_before = plain_before = done
                continue
            at = len(out) - 1
            data = piece.encode()
            counts = self.piece_counts(data)
            ends = np.cumsum([len(c.encode()) for c in piece])
            for i, end in enumerate(ends):
                if _is_space(piece[i]):
                    tail = text[run : at + i + 1]
                    out.append(run_before + self.piece_counts(tail.encode())[-1])
                else:
                    # a prefix of a contraction is split as an apostrophe and letters
                    here = counts[end - 1] if i + 1 == len(piece) or piece[0] != "'" or not piece[1:2].isalpha() else sum(map(self.piece, self.split(piece[: i + 1])))
                    out.append(done + here)
                    run, run_before = at + i + 1, out[-1]
            done += counts[-1]
            if not _is_space(piece[-1]):
                run, run_before = len(out) - 1, done
        return np.array(out, dtype=np.int64)

    def fits(self, text: str, limit: int, total: int) -> int:
        """Characters of a prefix that holds at most ``limit`` tokens: whole pieces, and of the next one what still fits."""
        if total <= limit:
            return len(text)
        done = at = 0
        for piece in self.split(text):
            n = 1 if piece in self.encoder.special else self.piece(piece)
            if done + n > limit:
                if piece not in self.encoder.special and not _is_space(piece[-1]) and piece[0] != "'":
                    counts = self.piece_counts(piece.encode())
                    ends = np.cumsum([len(c.encode()) for c in piece])
                    fit = [k for k, e in enumerate(ends[:-1], 1) if done + counts[e - 1] <= limit and not (k == 1 and _is_space(piece[0]))]
                    at += max(fit, default=0)
                return at
            done += n
            at += len(piece)
        return at


def _is_space(character: str) -> bool:
    """White space of the tokenizer's split, which leaves out the four separators that Python counts."""
    return character.isspace() and not "\x1c" <= character <= "\x1f"


def _split_keep(text: str, special: str) -> list[str]:
    parts = text.split(special)
    return [x for i, p in enumerate(parts) for x in ([special, p] if i else [p]) if x]


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def budget_cut(counts: np.ndarray, limit: int) -> int:
    """Characters of a prefix within ``limit`` tokens, from stored prefix counts, such that no shorter prefix exceeds it."""
    return bisect_right(np.maximum.accumulate(counts), limit) - 1


def token_counts(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, vocabulary: str | None = None
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, fits_chars.

    ``n_tokens`` is the library's count without added tokens; special strings inside texts count as one token, as is the
    library's default. ``fits_chars`` is the length of a prefix that holds at most ``limit`` tokens, cut inside the last
    piece from its prefix counts, without encoding anything again.

    No shuffle; a worker keeps a bounded table of counts. Defined cases: a null text is empty and has no tokens; null and
    repeated ids give a row each; texts of any length are counted whole; other columns are ignored.
    """
    path = vocabulary or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [counts.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()),
                pa.array([c > limit for c in n]), pa.array([counts.fits(t, limit, c) for t, c in zip(texts, n)], pa.int64()),
            ], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"])

    return documents.select(id_col, text_col).mapInArrow(count, OUT)
