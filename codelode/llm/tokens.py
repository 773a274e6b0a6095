"""Token ids of whole texts inside Arrow batches, as the tokenizers library gives them.

``public_tokenizers.path`` finds the vocabulary; a path of another byte-level BPE file in the same form works too.
"""

import re
import unicodedata
from codecs import charmap_decode

import numpy as np
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
_BELOW = 0x250  # characters whose classes the split below spells out
LAST = chr(_BELOW)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_BELOW) if unicodedata.category(chr(c))[0] == kind)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = {b: c for b, c in _byte_letters().items() if ord(c) != b}
_LETTER_TABLE = "".join(c for _, c in sorted(_byte_letters().items()))
LETTERS, NUMBERS = _class("L"), _class("N")
SPACES = " \t\n\v\f\r"
#: The split of byte-level BPE for texts of these characters only; anything else goes to the library whole.
PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
SIMPLE = re.compile("[" + "".join(
    re.escape(chr(c)) for c in range(_BELOW)
    if chr(c) in SPACES or not (chr(c).isspace() or unicodedata.category(chr(c)) in ("Cc", "Cn"))
) + "]*")


def letters(text: str) -> str:
    """A text's UTF-8 bytes as the vocabulary writes them."""
    return charmap_decode(text.encode(), "strict", _LETTER_TABLE)[0]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    A split between a character that is no space and a single space before another one never changes the ids, so a
    text is cut there, and each distinct part is encoded once and remembered, up to ``most`` parts (the table is
    bounded; parts met later are encoded each time). Parts of simple characters are split here and encoded by the
    library's model; other texts (double spaces, special strings, rare scripts) go through the library whole.
    """

    def __init__(self, path: str, most: int = 800_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.most, self.parts, self.pieces = most, {}, {}
        self.marks = {mark: self.piece(mark) for mark in ".,;:!?"}

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def model_ids(self, letters: str) -> bytes:
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(letters)])

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = self.model_ids(letters(piece))
            if len(self.pieces) < self.most // 4 and len(piece) < 64:
                self.pieces[piece] = found
        return found

    def word(self, word: str) -> bytes:
        """The ids of a space and simple letters."""
        found = self.parts.get(word)
        return self.new_word(word) if found is None else found

    def new_word(self, word: str) -> bytes:
        found = self.model_ids(letters(" " + word))
        if len(self.parts) < self.most and len(word) < 64:
            self.parts[word] = found
        return found

    def part(self, part: str) -> bytes | None:
        """The ids of a part with the space before it (marked parts: see ``encode``); None where that isn't safe."""
        if not part:
            return None
        simple = part.isascii() or max(part) < LAST
        if simple and part.isalpha():
            return self.new_word(part)
        if simple and part[-1] in self.marks and part[:-1].isalpha():
            found = self.word(part[:-1]) + self.marks[part[-1]]
        elif part[0].isspace() and part[0] != " " or part[-1].isspace() or not SIMPLE.fullmatch(part):
            return None
        elif any(s in part for s in self.special):
            return None
        else:
            found = b"".join(map(self.piece, PIECES.findall(part[1:] if part[0] == " " else " " + part)))
        if len(self.parts) < self.most and len(part) < 64:
            self.parts[part] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        parts = text.split(" ")
        parts[0] = " " + parts[0]  # marks the first part, which has no space before it
        found = list(map(self.parts.get, parts))
        if None in found:
            for i, known in enumerate(found):
                if known is None:
                    found[i] = self.part(parts[i]) if parts[i] != " " else None
                    if found[i] is None:
                        return self.library(text)
        return b"".join(found)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), dtype="<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, as workers serve many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
