"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

Merging pairs in rank order gives every prefix of a word one encoding, and an encoding is exactly a row of tokens whose neighbours
are compatible: merging the two tokens' symbols alone gives those two tokens again. So the last token of every prefix is unique:

1. the suffix automaton of the vocabulary lists all tokens that end at each place of the word;
2. of those, the one compatible with the last token of the prefix in front of it is stored;
3. following the stored tokens back from the end of the word gives its ids.

Pair tests and words are remembered in bounded maps that are local to a Python worker. Words are told apart as the vocabulary's file says:
NFC, white space to one space, lower case, then runs of letters, single digits, runs of other signs and the usual contractions.

Defined results: NULL text counts as empty, which has no ids and decodes to ''. Rows pass through one by one, whatever their ids or other columns.
"""

from __future__ import annotations

import json
import string
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wearline.llm.byte_tokens import byte_symbols
from wearline.llm.common import Memo, arrow_map, whole_text

WORD_BPE = "word_bpe_49k.json"
_SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_SPACES = regex.compile(f"[{_SPACE}]+")
#: Longest word, with signs, that is remembered.
_WORD_CHARS = 64
#: Letters of a batch whose ids and texts are held at a time.
_HELD_CHARS = 1_000_000
#: Python's splitting also takes these for white space.
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
#: Stands for the end of a word behind its last symbol.
_END = chr(0xE000)


def default_path() -> str:
    return public_tokenizers.path(WORD_BPE)


class Letters:
    """The vocabulary's words and lower case in the character tables of the tokenizers library.

    Python's table is older and that of the `regex` package newer than the library's, so the few characters only the latter knows are
    looked up in the library itself.
    """

    def __init__(self, path: str):
        classes: dict[str, list[int]] = {"L": [], "N": []}
        unknown = []
        for code in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(code))
            if kind[0] in classes:
                classes[kind[0]].append(code)
            elif kind == "Cn":
                unknown.append(chr(code))
        library = Tokenizer.from_file(path)
        lower: dict[int, str] = {}
        for c in regex.findall(r"[\p{L}\p{N}]", "".join(unknown)):
            small = library.normalizer.normalize_str(c)
            if small != c:
                lower[ord(c)] = small
            if len(library.pre_tokenizer.pre_tokenize_str(f"a{c}a")) == 1:
                classes["L"].append(ord(c))
            elif len(library.pre_tokenizer.pre_tokenize_str(c + c)) == 2:
                classes["N"].append(ord(c))
        letters, numerals = (_ranges(sorted(classes[c])) for c in "LN")
        #: Contractions, runs of letters, single numerals, runs of other signs.
        self.words = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numerals}]|[^{_SPACE}{letters}{numerals}]+")
        self.capitals = regex.compile(f"[{_ranges(sorted(lower))}]") if lower else None
        self.small = lower

    def lower(self, text: str) -> str:
        text = text.lower()
        return text.translate(self.small) if self.capitals is not None and self.capitals.search(text) else text


def _ranges(codes: list[int]) -> str:
    """Sorted code points as the inside of a character class."""
    found: list[list[int]] = []
    for code in codes:
        if found and found[-1][1] == code - 1:
            found[-1][1] = code
        else:
            found.append([code, code])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in found)


class WordEncoder:
    """Encodes and decodes with a vocabulary whose words carry an end sign and whose pieces stand for bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as stream:
            file = json.load(stream)
        model = file["model"]
        self.end = model["end_of_word_suffix"]
        vocabulary = model["vocab"]
        self.tokens = [""] * (1 + max([*vocabulary.values(), *(t["id"] for t in file["added_tokens"])]))
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        for token, number in [*vocabulary.items(), *self.special.items()]:
            self.tokens[number] = token
        self.special_split = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")")
        self.symbols = byte_symbols()
        self.ranks = {(a, b): i for i, (a, b) in enumerate(model["merges"])}
        self.automaton = ahocorasick.Automaton()
        for token, number in vocabulary.items():
            if token not in self.special:
                marked = token.removesuffix(self.end) + _END if token.endswith(self.end) else token
                self.automaton.add_word(marked, (len(marked), number))
        self.automaton.make_automaton()
        self.parts = Memo(self._parts, 50_000)
        self.fits = Memo(self._fits, 200_000)
        self.pieces = Memo(self._encode_piece, 20_000, _WORD_CHARS)
        self.chunks = Memo(self._encode_chunk, 150_000, _WORD_CHARS)
        self.letters = Letters(path)
        self.words = self.letters.words

    def _parts(self, number: int) -> tuple[str, ...]:
        """The symbols of a token: characters, the last one with the end sign."""
        token = self.tokens[number]
        body = token.removesuffix(self.end)
        return (*body[:-1], body[-1] + token[len(body) :]) if body else (token,)

    def _merged(self, symbols: list[str]) -> list[str]:
        """Merging a few symbols in rank order."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(pair, len(self.ranks)), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
            if rank == len(self.ranks):
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _fits(self, pair: int) -> bool:
        """Whether two tokens, `(left + 1) << 20 | right`, can stand side by side; a left of -1 is the start of a word."""
        left, right = (pair >> 20) - 1, pair & 0xFFFFF
        numbers = [right] if left < 0 else [left, right]
        return self._merged([s for n in numbers for s in self.parts[n]]) == [self.tokens[n] for n in numbers]

    def _encode_piece(self, piece: str) -> bytes:
        """The ids of one word by the last tokens of its prefixes."""
        text = "".join([self.symbols[b] for b in piece.encode("utf-8", "surrogatepass")])
        n = len(text)
        last: list[int] = [-1] * (n + 2)  # by number of symbols in the prefix; n + 1 stands for the ended word
        came: list[int] = [-1] * (n + 2)
        known = [True] + [False] * (n + 1)
        fits = self.fits
        for stop, (length, number) in self.automaton.iter(text + _END):
            end, start = stop + 1, stop + 1 - length
            if not known[end] and known[start] and fits[(last[start] + 1) << 20 | number]:
                known[end], last[end], came[end] = True, number, start
        if not known[n + 1]:
            raise ValueError(f"no encoding of {piece!r}")
        found, at = [], n + 1
        while at > 0:
            found.append(last[at])
            at = came[at]
        return struct.pack(f"<{len(found)}I", *reversed(found))

    def _encode_chunk(self, chunk: str) -> bytes:
        """The ids of what stands between white space; letters with signs behind them are two words."""
        stem = chunk.rstrip(string.punctuation)
        if stem.isalpha():  # letters are remembered as chunks, other pieces apart
            return self._encode_piece(stem) if len(stem) == len(chunk) else self.chunks[stem] + self.pieces[chunk[len(stem) :]]
        return b"".join([self.chunks[piece] if piece.isalpha() else self.pieces[piece] for piece in self.words.findall(chunk)])

    def _encode_plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case knows no final sigma here
            text = self.letters.lower(text)
        else:
            text = text.lower()
        chunks = _SPACES.split(text) if _SEPARATORS.search(text) else text.split()
        memo = self.chunks
        return b"".join([memo[c] for c in chunks])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; special tokens in the text count as such."""
        if not any(t in text for t in self.special):
            return self._encode_plain(text)
        return b"".join(struct.pack("<I", self.special[p]) if p in self.special else self._encode_plain(p) for p in self.special_split.split(text))

    def decode(self, ids: bytes) -> str:
        """The tokens with a space between them, as the vocabulary names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in memoryview(ids).cast("I")]) if ids else ""


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every whole text."""
    path = path or default_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = encoder(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one.encode(t) for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col)), rows, "doc_id long, ids binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids and the text decoded from them, `decode(encode(docs))` in one pass; a task holds the ids of some texts at a time."""
    path = path or default_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, start, held, ids, texts = encoder(path), 0, 0, [], []
            for i, text in enumerate(batch.column(1)):
                whole = text.as_py()
                ids.append(one.encode(whole))
                texts.append(one.decode(ids[-1]))
                held += len(whole)
                if held >= _HELD_CHARS or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[start : i + 1], pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])
                    start, held, ids, texts = i + 1, 0, [], []

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col)), rows, "doc_id long, ids binary, decoded string")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of `encode` with the decoded text."""
    path = path or default_path()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = encoder(path)
            texts = [one.decode(b) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return arrow_map(encoded.select("doc_id", "ids"), rows, "doc_id long, ids binary, decoded string")
