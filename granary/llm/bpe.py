"""BPE encoding and decoding by a prefix-sharing trie traversal.

Let last(p) be the last token of the encoding of a word's prefix p. It is the one token t that p ends with such that
the encoding of p without t ends in a token that may stand before t, i.e. one whose pair with t encodes to just these
two. So the encoding of p is that of the shorter prefix and t, and one state a prefix suffices for all of them. The
distinct words of a slice of texts, in byte order, are the depth-first walk of their trie: the states of the prefix
that a word shares with the one before it are kept, and only the rest of its path is worked out. A word's tokens are
read off backwards from its end.

Words come from the pre-tokenizer's pattern. Added tokens in a text are found first, as the library does, and parted
from what surrounds them. Each Python worker keeps the words it has met, up to ``CACHE_WORDS``.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import arrow_scalar, columns_kept, read, ship

CACHE_WORDS = 400_000
#: Words held at once while a long text is worked through.
_STEP = 100_000
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


@lru_cache(1)
def _classes() -> list[list[list[int]]]:
    """First and last code points of the runs of the letters and of the numbers, as the library's pre-tokenizer has them.

    Two Unicode tables are at hand, of unlike age; where they differ, the library is asked.
    """
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    every = [*map(chr, range(0xD800)), *map(chr, range(0xE000, sys.maxunicode + 1))]
    ask = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    out = []
    for initial, like in (("L", "a"), ("N", "1")):
        old = {c for c in every if unicodedata.category(c)[0] == initial}
        new = set(regex.findall(rf"\p{{{initial}}}", "".join(every)))
        mine = sorted((old & new) | {c for c in old ^ new if len(ask(like + c)) == 1})
        runs: list[list[int]] = []
        for c in map(ord, mine):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        out.append(runs)
    return out


def _pattern_up_to(top: int) -> re.Pattern[str]:
    """The byte-level pre-tokenizer's pattern in terms of ``re``, for texts without code points above ``top``:
    contractions, letters, numbers, others, white space."""
    letter, number = ("".join(f"\\U{a:08x}-\\U{min(b, top):08x}" for a, b in runs if a <= top) for runs in _classes())
    s = "".join(c for c in _SPACES if ord(c) <= top)
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{s}{letter}{number}]+|[{s}]+(?![^{s}])|[{s}]+")


@lru_cache(1)
def _patterns() -> list[tuple[re.Pattern[str], re.Pattern[str]]]:
    """By growing range: what finds a character above it, and the pattern for texts without such; small classes are fast."""
    return [(re.compile(f"[\\U{top + 1:08x}-\\U{sys.maxunicode:08x}]"), _pattern_up_to(top)) for top in (0xFF, 0xFFFF)]


@lru_cache(1)
def _full() -> re.Pattern[str]:
    return _pattern_up_to(sys.maxunicode)


def _pattern_for(text: str) -> re.Pattern[str]:
    return next((p for above, p in _patterns() if not above.search(text)), None) or _full()


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary, read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model["ignore_merges"]:
            raise ValueError(f"{path}: only a byte-level BPE without normalizer or prefix space is known here")
        alphabet = _byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        self.tokens: dict[int, bytes] = {i: b for b, i in self.ids.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens with conditions are not known here")
        self.tokens |= {i: s.encode() for s, i in self.added.items()}
        self.rank: dict[tuple[int, int], int] = {}
        #: The two tokens that each token was merged from.
        self.halves: dict[int, tuple[int, int]] = {}
        made: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair = self.ids[raw(a)], self.ids[raw(b)]
            self.rank[pair] = r
            new = self.ids[raw(a + b)]
            if new not in made:
                made[new], self.halves[new] = r, pair
        #: When a token comes to be: single bytes before any merge.
        self.birth = {t: made.get(t, -1) for t in self.tokens}
        self.whole = {b: t for b, t in self.ids.items() if len(b) == 1 or t in self.halves and self.meets(*self.halves[t], until=made[t])}
        #: By a token's last three bytes, the lengths of the tokens that end so, longest first.
        ends: dict[bytes, set[int]] = {}
        for b in self.whole:
            ends.setdefault(b[-3:], set()).add(len(b))
        self.ends = {b: tuple(sorted(n, reverse=True)) for b, n in ends.items()}
        self._fits: dict[tuple[int, int], bool] = {}
        self.split = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")") if self.added else None

    def meets(self, a: int, b: int, until: int | None = None) -> bool:
        """Whether tokens ``a`` and ``b``, each made from its own bytes, come to stand side by side: whether no merge
        joins bytes of both before (``until``: before that merge, else ever).

        The merges are undone, the latest first; the two tokens at the border during each stretch of time must not be
        a pair that merges in it. Of equal merges the left one goes first.
        """
        limit = len(self.rank) if until is None else until
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < limit:
                return False
            born_a, born_b = self.birth[a], self.birth[b]
            if born_a < 0 and born_b < 0:
                return True
            if born_a > born_b:
                a, limit = self.halves[a][1], born_a
            else:
                b, limit = self.halves[b][0], born_b + 1

    def fits(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[key] = self.meets(a, b)
        return known

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each distinct word, in byte order, with its tokens."""
        whole, fits, ends, tokens = self.whole.get, self.fits, self.ends.get, self.tokens
        before, last = b"", [-1]  # last[n]: the last token of the word's first n bytes
        for word in sorted(words):
            shared = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for k in (3, 2, 1):
                    for n in ends(word[end - k : end], ()) if k <= end else ():
                        if n <= end and (t := whole(word[end - n : end])) is not None and (n == end or fits(last[end - n], t)):
                            break
                    else:
                        continue
                    break
                else:
                    raise ValueError(f"no token can end {word[:end]!r}: the vocabulary lacks single bytes")
                last.append(t)
            before, out, at = word, [], len(word)
            while at:
                out.append(t := last[at])
                at -= len(tokens[t])
            yield word, out[::-1]


class Encoder:
    """Texts to little-endian 32-bit ids and back, with a bounded cache of words."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.cache: dict[str, bytes] = {}
        top = max(self.vocabulary.tokens) + 1
        self.table = [self.vocabulary.tokens.get(i, b"") for i in range(top)]

    def _words(self, text: str) -> Iterator[list[str]]:
        """The pre-tokenizer's words in bounded lists; an added token stands as a list of its own."""
        split, find = self.vocabulary.split, _pattern_for(text)
        for part in split.split(text) if split else [text]:
            if split and part in self.vocabulary.added:
                yield [part]
            elif len(part) <= 8 * _STEP:
                yield find.findall(part)
            else:
                found = (m[0] for m in find.finditer(part))
                while words := list(islice(found, _STEP)):
                    yield words

    def _learn(self, words: set[str]) -> None:
        new = {w.encode(): w for w in words if w not in self.cache and w not in self.vocabulary.added}
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache = {w: self.cache[w] for w in words if w in self.cache}
        for b, ids in self.vocabulary.encode_words(new):
            self.cache[new[b]] = pack(f"<{len(ids)}I", *ids)
        for s, i in self.vocabulary.added.items():
            self.cache[s] = i.to_bytes(4, "little")

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text. The words of a slice of texts are walked as one trie."""
        lists = {i: list(self._words(t)) for i, t in enumerate(texts) if len(t) <= 8 * _STEP}
        self._learn(set().union(*(w for ws in lists.values() for w in ws)))
        for i, t in enumerate(texts):
            if i in lists:
                yield b"".join([b"".join(map(self.cache.__getitem__, ws)) for ws in lists.pop(i)])
                continue
            out = []
            for ws in self._words(t):
                self._learn(set(ws))
                out.append(b"".join(map(self.cache.__getitem__, ws)))
            yield b"".join(out)
            self._learn(set().union(*(w for ws in lists.values() for w in ws)))

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids; bytes that are no UTF-8 become U+FFFD. Unknown ids are left out."""
        table, at = self.table, np.frombuffer(ids, "<u4")
        parts = []
        for lo in range(0, len(at), 8 * _STEP):
            piece = at[lo : lo + 8 * _STEP]
            parts.append(b"".join(map(table.__getitem__, (piece if piece.max() < len(table) else piece[piece < len(table)]).tolist())))
        return b"".join(parts).decode("utf-8", "replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _texts(col: pa.Array) -> list[str]:
    return [v or "" for v in col.to_pylist()]


def encode_column(text: Column, path: str) -> Column:
    """array<int>: the ids of a text under the tokenizer file at ``path``. A null text is empty."""

    def run(col: pa.Array) -> pa.Array:
        ids = list(encoder(path).encode(_texts(col)))
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))

    return arrow_scalar(run, "array<int>")(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of an array<int> of ids. Null ids, and ids outside the vocabulary, are left out; a null array is empty."""

    def run(col: pa.Array) -> pa.Array:
        return pa.array([encoder(path).decode(np.array([i for i in v or () if i is not None and i >= 0], "<u4").tobytes()) for v in col.to_pylist()], pa.string())

    return arrow_scalar(run, "string")(ids)


_DIGEST = "struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>"


def digest_column(text: Column, path: str) -> Column:
    """n_tokens, ids_sha256 and decoded_sha256 of a text that is encoded and then decoded from its ids alone."""

    def run(col: pa.Array) -> pa.Array:
        coder, sha = encoder(path), lambda b: hashlib.sha256(b).hexdigest()
        rows = [(len(ids) // 4, sha(ids), sha(coder.decode(ids).encode())) for ids in coder.encode(_texts(col))]
        n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_scalar(run, _DIGEST)(text)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): a row for each row of ``docs``; repeated rows repeat, a null text has no tokens."""
    ship(docs.sparkSession)
    rows = columns_kept(docs, {"doc_id": id_col, "text": text_col})
    return rows.select("doc_id", encode_column(F.col("text"), path).alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): a row for each row of ``docs``; repeated rows repeat.

    A null text is an empty one; a null id stays null. Texts of any length are encoded whole. Other columns don't
    matter, whatever their names. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = columns_kept(docs, {"doc_id": id_col, "text": text_col})
    return rows.select("doc_id", digest_column(F.col("text"), path).alias("d")).select("doc_id", "d.*")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
