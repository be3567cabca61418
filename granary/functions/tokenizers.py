"""WordPiece and unigram tokenizers as plain classes, and as Arrow functions over columns of text."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: The special tokens, the longest word looked up, and the default lengths with special tokens.
PAD, UNK, CLS, SEP = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
LONGEST_WORD, WORDPIECE_LENGTH, UNIGRAM_LENGTH = 100, 160, 512
#: The mark of a space, how far an unknown character is under the worst piece.
SPACE_MARK, UNKNOWN_PENALTY = "▁", 10.0
_CJK = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


def is_punctuation(c: str) -> bool:
    """The ASCII blocks of signs, though some are no punctuation in Unicode, and Unicode's punctuation."""
    o = ord(c)
    return 33 <= o <= 47 or 58 <= o <= 64 or 91 <= o <= 96 or 123 <= o <= 126 or unicodedata.category(c)[0] == "P"


class _Letters(dict):
    """A table for ``str.translate`` that works a letter out when it is first met."""

    def __init__(self, of: Callable[[str], str]) -> None:
        self.of = of

    def __missing__(self, o: int) -> str:
        self[o] = self.of(chr(o))
        return self[o]


def _cleaned(c: str) -> str:
    if c in "\t\n\r" or unicodedata.category(c) == "Zs":
        return " "
    if c in "\0\ufffd" or unicodedata.category(c) in ("Cc", "Cf", "Co", "Cs"):
        return ""
    return f" {c} " if any(a <= ord(c) <= b for a, b in _CJK) else c


_CLEANED = _Letters(_cleaned)
_UNMARKED = _Letters(lambda c: "" if unicodedata.category(c) == "Mn" else c)
_PARTED = _Letters(lambda c: f" {c} " if is_punctuation(c) else c)


def bert_normalize(text: str, lower: bool = True, strip_accents: bool = True) -> str:
    """Controls go, white space becomes a space, ideographs stand alone; then case and accents as asked for."""
    s = text.translate(_CLEANED)
    if lower:
        s = s.lower()
    if s.isascii():
        return s
    return unicodedata.normalize("NFD", s).translate(_UNMARKED) if strip_accents else unicodedata.normalize("NFC", s)


def pre_tokenize(text: str) -> list[str]:
    """Words between white space; each punctuation character by itself."""
    return text.translate(_PARTED).split()


class WordPiece:
    """Greedy longest match; a word with a rest that nothing matches is unknown as a whole."""

    def __init__(self, vocab: dict[str, int], lower: bool = True, strip_accents: bool = True, length: int = WORDPIECE_LENGTH) -> None:
        self.vocab, self.lower, self.strip, self.length = vocab, lower, strip_accents, length

    def pieces(self, word: str) -> list[str]:
        if len(word) > LONGEST_WORD:
            return [UNK]
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                piece = ("##" if at else "") + word[at:end]
                if piece in self.vocab:
                    out.append(piece)
                    at = end
                    break
            else:
                return [UNK]
        return out

    def encode(self, text: str | None) -> list[int]:
        ids = [self.vocab[CLS]]
        for word in pre_tokenize(bert_normalize(text or "", self.lower, self.strip)):
            for piece in self.pieces(word):
                if len(ids) >= self.length - 1:
                    return [*ids, self.vocab[SEP]]
                ids.append(self.vocab[piece])
        return [*ids, self.vocab[SEP]]


def nfkc_normalize(text: str) -> str:
    """Compatibility forms, no controls, odd and zero-width spaces as spaces, runs of spaces as one."""
    out = []
    for c in unicodedata.normalize("NFKC", text):
        if c in "\t\n\r​‎‏  ﻿" or unicodedata.category(c) == "Zs":
            out.append(" ")
        elif unicodedata.category(c) == "Cc":
            continue
        else:
            out.append(c)
    return " ".join("".join(out).split())


def metaspace(text: str) -> list[str]:
    """A mark before the text and for every space; parts begin at marks."""
    if not text:
        return []
    s = text.replace(" ", SPACE_MARK)
    s = s if s.startswith(SPACE_MARK) else SPACE_MARK + s
    return [SPACE_MARK + p for p in s.split(SPACE_MARK)[1:]]


class Unigram:
    """The likeliest segmentation by dynamic programming; runs of unknown characters are one unknown token."""

    def __init__(self, pieces: Sequence[tuple[str, float]], unk: int = 0, bos: int | None = None, eos: int | None = None, length: int = UNIGRAM_LENGTH) -> None:
        self.table = {p: (i, s) for i, (p, s) in enumerate(pieces)}
        self.unk, self.bos, self.eos, self.length = unk, bos, eos, length
        self.worst = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.longest = max((len(p) for p, _ in pieces), default=1)

    def segment(self, part: str) -> list[int]:
        best, back = [0.0] + [-math.inf] * len(part), [(0, 0)] * (len(part) + 1)
        for end in range(1, len(part) + 1):
            for at in range(max(0, end - self.longest), end):
                found = self.table.get(part[at:end])
                score = found[1] if found else self.worst if end - at == 1 else None
                if score is not None and best[at] + score > best[end]:
                    best[end], back[end] = best[at] + score, (at, found[0] if found else self.unk)
        out, at = [], len(part)
        while at:
            at, i = back[at]
            if not (i == self.unk and out and out[-1] == self.unk):
                out.append(i)
        return out[::-1]

    def tokenize(self, text: str | None) -> list[int]:
        return [i for p in metaspace(nfkc_normalize(text or "")) for i in self.segment(p)]

    def encode(self, text: str | None) -> list[int]:
        ends = (self.bos is not None) + (self.eos is not None)
        ids = self.tokenize(text)[: self.length - ends]
        return [*([] if self.bos is None else [self.bos]), *ids, *([] if self.eos is None else [self.eos])]


def pad(batch: list[list[int]], pad_id: int = 0) -> tuple[list[list[int]], list[list[int]]]:
    """Ids filled up to the longest, and the mask; an empty batch gives empty lists."""
    n = max(map(len, batch), default=0)
    return [x + [pad_id] * (n - len(x)) for x in batch], [[1] * len(x) + [0] * (n - len(x)) for x in batch]


def encode_column(text: Column, tokenizer: WordPiece | Unigram) -> Column:
    """struct(ids, mask) of each text."""
    kind = StructType([StructField("ids", ArrayType(IntegerType())), StructField("mask", ArrayType(IntegerType()))])

    def run(col: pa.Array) -> pa.Array:
        ids = [tokenizer.encode(t) for t in col.to_pylist()]
        ints = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(ids, ints), pa.array([[1] * len(x) for x in ids], ints)], ["ids", "mask"])

    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR)(text)


def words_column(text: Column, lower: bool = True, strip: bool = True) -> Column:
    """The words and signs that pieces are made from."""
    return F.arrow_udf(lambda col: pa.array([pre_tokenize(bert_normalize(t or "", lower, strip)) for t in col.to_pylist()], pa.list_(pa.string())), ArrayType(StringType()), F.ArrowUDFType.SCALAR)(text)


def pieces_column(text: Column, tokenizer: WordPiece) -> Column:
    def run(col: pa.Array) -> pa.Array:
        return pa.array([[p for w in pre_tokenize(bert_normalize(t or "", tokenizer.lower, tokenizer.strip)) for p in tokenizer.pieces(w)] for t in col.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, ArrayType(StringType()), F.ArrowUDFType.SCALAR)(text)


@lru_cache(1)
def letters_vocab() -> dict[str, int]:
    """A small vocabulary by rule: special tokens, then letters and digits with and without the mark of a continuation."""
    signs = "abcdefghijklmnopqrstuvwxyz0123456789"
    return {t: i for i, t in enumerate([PAD, UNK, CLS, SEP, *signs, *("##" + c for c in signs)])}
