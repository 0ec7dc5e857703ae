"""Exact token ids of the byte-level vocabulary, with words remembered between documents.

The vocabulary's pattern never lets a token reach across the place in front of a space that a non-space follows. A text
is cut at those places; every distinct piece is encoded once by the tokenizers library, many pieces in one call, and
the ids are told apart by the byte lengths of the tokens. The map of pieces is bounded and local to a Python worker.
"""

from __future__ import annotations

import re
import string

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from wearline.llm.common import Memo, held

BYTE_BPE = "byte_bpe_50k.json"
_CUT = re.compile(r" (?=\S)")
_OTHER_SPACE = re.compile(r" (?=\s|\Z)")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + others.index(b)) for b in range(256)]


def default_path() -> str:
    return public_tokenizers.path(BYTE_BPE)


class _Known(dict):
    """A bounded map; when it is full, what was met since the last renewal stays for one more round."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.older = size, {}

    def renew(self) -> None:
        """Makes room if need be; nothing leaves the map otherwise."""
        if len(self) > self.size:
            self.older.clear()
            self.older.update(self)
            self.clear()

    def unknown(self, words: set[str]) -> list[str]:
        """Those of `words` that were not met lately; the others are in the map now."""
        found = []
        for word in words:
            if (value := self.older.get(word)) is not None:
                self[word] = value
            elif word not in self:
                found.append(word)
        return found


class ByteEncoder:
    """Token ids of whole texts as little-endian unsigned 32-bit integers.

    Most pieces are letters with signs behind them, which the pattern takes apart there; their letters are remembered as pieces of
    their own. All encoding is the library's.
    """

    def __init__(self, path: str, size: int = 300_000):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, number in vocabulary.items():  # one character of a byte-level token is one byte
            self.lengths[number] = len(token)
        self.pieces = _Known(size)
        self.signs = Memo(self._whole, 10_000)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes() if text else b""

    def _after_space(self, words: list[str]) -> list[bytes]:
        """The ids of every word with a space before it, in one call."""
        if not words:
            return []
        ids = np.asarray(self.tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.cumsum([1 + (len(w) if w.isascii() else len(w.encode())) for w in words])
        stops = (4 * (np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1)).tolist()
        packed = ids.tobytes()
        return [packed[start:stop] for start, stop in zip([0, *stops], stops)]

    def _learn(self, words: list[str]) -> None:
        split, others = [], []
        for word in words:
            stem = word.rstrip(string.punctuation)
            if stem.isalpha():
                split.append((word, stem))
            else:
                others.append(word)
        pieces = self.pieces
        unknown = pieces.unknown({stem for _, stem in split if stem not in pieces})
        pieces.update(zip(unknown, self._after_space(unknown)))
        for word, stem in split:
            if word is not stem:
                pieces[word] = pieces[stem] + self.signs[word[len(stem) :]]
        pieces.update(zip(others, self._after_space(others)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text; the same as encoding it whole."""
        found: list[bytes] = []
        start = 0
        while start < len(texts):  # some texts at once, so that the library is called less often
            stop, letters = start + 1, len(texts[start])
            while stop < len(texts) and letters < 200_000:
                letters += len(texts[stop])
                stop += 1
            found += self._encode_some(texts[start:stop])
            start = stop
        return found

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        pieces = self.pieces
        pieces.renew()
        parts = [t.split(" ") if _OTHER_SPACE.search(t) is None else _CUT.split(t) for t in texts]
        heads = self.tokenizer.encode_batch_fast([p.pop(0) for p in parts], add_special_tokens=False)
        ids = [list(map(pieces.get, p)) for p in parts]
        missing = {w for p, known in zip(parts, ids) if None in known for w, k in zip(p, known) if k is None}
        if missing:
            self._learn(pieces.unknown(missing))
            ids = [[pieces[w] if k is None else k for w, k in zip(p, known)] if None in known else known for p, known in zip(parts, ids)]
        return [np.asarray(h.ids, dtype="<u4").tobytes() + b"".join(known) for h, known in zip(heads, ids)]


def encoder(path: str) -> ByteEncoder:
    return held(("byte tokens", path), lambda: ByteEncoder(path))
