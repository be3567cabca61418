"""Folds and small functions on text, as expressions; the few that need a loop are Arrow functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Letters and those that sound alike in queries by single letters.
SOUND_ALIKES = {"t": "qQ", "d": "fF", "n": "x|", "r": "V", "y": "X", "i": "e", "o": "Ea", "u": "a", "f": "P", "w": "v"}


@F.arrow_udf(StringType())
def nfd(col: pa.Array) -> pa.Array:
    return pa.array([None if v is None else unicodedata.normalize("NFD", v) for v in col.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def nfc(col: pa.Array) -> pa.Array:
    return pa.array([None if v is None else unicodedata.normalize("NFC", v) for v in col.to_pylist()], pa.string())


def text_of(v: Column) -> Column:
    """Null is empty."""
    return F.coalesce(v.cast("string"), F.lit(""))


def collapse(v: Column) -> Column:
    return F.trim(F.regexp_replace(v, r"\s+", " "))


def strip_accents(v: Column) -> Column:
    """Whatever Unicode can decompose, without the marks from U+0300 to U+036F. Texts in ASCII don't go to Python."""
    return F.regexp_replace(F.coalesce(nfd(_beyond_ascii(v)), v), r"[\x{0300}-\x{036F}]", "")


def composed(v: Column) -> Column:
    """:func:`nfc`, for which texts in ASCII don't go to Python."""
    return F.coalesce(nfc(_beyond_ascii(v)), v)


def _beyond_ascii(v: Column) -> Column:
    return F.when(F.octet_length(v) > F.length(v), v)


def fold_native(v: Column) -> Column:
    """The dot below and the doubling sign go, white space collapses."""
    return collapse(F.regexp_replace(text_of(v), "[਼ੱ]", ""))


def fold_roman(v: Column) -> Column:
    """Lower case without accents; all but letters, digits and spaces becomes a space."""
    return collapse(F.regexp_replace(strip_accents(F.lower(text_of(v))), r"[^a-z0-9 ]", " "))


def loose_roman(v: Column) -> Column:
    """A spelling that transliterations agree on: see the steps, whose order matters."""
    x = strip_accents(F.lower(text_of(v)))
    for pattern, to in (
        (r"['’()]", ""),
        (r"[^a-z]+", " "),
        (r"([bcdgjklmnpqrstvxz])h", "$1"),
    ):
        x = F.regexp_replace(x, pattern, to)
    x = F.regexp_replace(F.translate(x, "eyowzf", "iiuvjp"), r"([a-z])\1+", "$1")
    words = F.filter(F.split(F.trim(x), " +"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(F.length(w) > 2, F.regexp_replace(w, "[iu]$", "")).otherwise(w)), " ")


def fold_native_text(text: str | None) -> str:
    """:func:`fold_native` of one text, after composing what can be."""
    return " ".join(unicodedata.normalize("NFC", text or "").replace("਼", "").replace("ੱ", "").split())


def loose_roman_text(text: str | None) -> str:
    """:func:`loose_roman` of one text, for queries."""
    s = re.sub(r"[̀-ͯ'’()]", "", unicodedata.normalize("NFD", (text or "").lower()))
    s = re.sub(r"([bcdgjklmnpqrstvxz])h", r"\1", re.sub(r"[^a-z]+", " ", s))
    s = re.sub(r"[ou]", "u", re.sub(r"[eiy]", "i", s)).translate(str.maketrans("wzf", "vjp"))
    words = re.sub(r"([a-z])\1+", r"\1", s).split()
    return " ".join(re.sub("[iu]$", "", w) if len(w) > 2 else w for w in words)


def letter_classes(query: str) -> str:
    """A pattern in which every letter also meets its other case and what sounds like it."""
    return "".join(f"[{re.escape(''.join(dict.fromkeys(c.lower() + c.upper() + SOUND_ALIKES.get(c.lower(), ''))))}]" for c in query if not c.isspace())


def has_native(v: Column) -> Column:
    return v.rlike("[਀-੿]")


def absent(v: Column) -> Column:
    return v.isNull() | (v.cast("string") == "")


def capped(v: Column, most: int = 200) -> Column:
    """A text of at most ``most`` characters, trimmed; longer ones are refused with a null."""
    return F.when(F.length(text_of(v)) <= most, F.trim(text_of(v)))


def known_parts(v: Column, known: Sequence[str]) -> Column:
    """The parts of a list with commas that are known, each once, in their order; others are dropped."""
    parts = F.transform(F.split(text_of(v), ","), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: p.isin(*known)))


def image_address(url: Column, path: Column, published: str = "", mirror: str | None = None, local: str | None = None) -> Column:
    """An image's address: its own, moved from where it is ``published`` to a mirror if there is one; else its place under
    ``local``; null without either."""
    own = F.nullif(url, F.lit(""))
    moved = own if mirror is None else F.when(F.startswith(own, F.lit(published)), F.concat(F.lit(mirror), F.substring(own, F.lit(len(published) + 1), F.length(own)))).otherwise(own)
    there = F.lit(None).cast("string") if local is None else F.concat(F.lit(local), F.nullif(path, F.lit("")))
    return F.coalesce(moved, there)


def native_digits(v: Column) -> Column:
    return F.translate(v, "".join(chr(0xA66 + i) for i in range(10)), "0123456789")


def escape_html(v: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


def safe_query(search: Column, keep_q: bool = False) -> Column:
    """A query string without its ``q`` parameter, unless that may be kept."""
    if keep_q:
        return search
    parts = F.filter(F.split(F.regexp_replace(search, r"^\?", ""), "&"), lambda p: (p != "") & ~p.rlike("^q(=|$)"))
    return F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")


def normalize_ip(v: Column) -> Column:
    """Empty is unknown; an IPv4 address in IPv6 form is shown as IPv4."""
    bare = F.regexp_replace(F.trim(text_of(v)), r"(?i)^::ffff:(\d{1,3}(?:\.\d{1,3}){3})$", "$1")
    return F.when(bare == "", "unknown").otherwise(bare)


def record_id(book: Column, page: Column, seq: Column) -> Column:
    """``book:0042:3``; null where the book is no slug."""
    return F.when(book.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.format_string("%s:%04d:%d", book, page, seq))


def parse_record_id(v: Column) -> Column:
    ok = r"^([a-z0-9]+(?:-[a-z0-9]+)*):(\d{4}):(\d+)$"
    part = lambda i: F.regexp_extract(v, ok, i)
    return F.when(v.rlike(ok), F.struct(part(1).alias("book"), part(2).cast("int").alias("page"), part(3).cast("int").alias("seq")))


def indel(a: str, b: str) -> float:
    """1 - (m + n - 2 LCS) / (m + n); two empty texts are alike, one empty text is like nothing."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    return 1 - (len(a) + len(b) - 2 * _lcs(a, b)) / (len(a) + len(b))


def _lcs(a: str, b: str) -> int:
    """The length of the longest common subsequence, a row of its table at a time: a bit for each letter of ``a``, clear where the
    row goes up by one."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for c in b:
        u = row & places.get(c, 0)
        row = (row + u | row - u) & whole
    return len(a) - row.bit_count()


#: Strings of up to this many letters are compared many pairs at once; and the cells of letters that are held for it.
_WIDE, _CELLS = 256, 1 << 22


def _letters(texts: list[str], pad: int) -> np.ndarray:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    wide = max(1, int(sizes.max()))
    out = np.frombuffer("".join(t.ljust(wide, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), wide).copy()
    out[np.arange(wide) >= sizes[:, None]] = pad
    return out


def _lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    """As :func:`_lcs`, for many pairs at once: words of 64 bits, the sum's carry handed on from word to word."""
    x, y = _letters(a, 0xFFFFFFFF), _letters(b, 0xFFFFFFFE)
    n, wide = x.shape
    words = -(-wide // 64)
    row = np.full((n, words), 0xFFFFFFFFFFFFFFFF, np.uint64)
    bits = np.zeros((n, words * 8), np.uint8)
    for j in range(y.shape[1]):
        bits[:, : -(-wide // 8)] = np.packbits(x == y[:, j : j + 1], axis=1, bitorder="little")
        same = bits.view("<u8")
        carry = np.zeros(n, np.uint64)
        for w in range(words):
            v = row[:, w]
            u = v & same[:, w]
            total = v + u
            over = total < v
            total = total + carry
            carry = (over | (total < carry)).astype(np.uint64)
            row[:, w] = total | (v - u)
    return words * 64 - np.bitwise_count(row).sum(1, dtype=np.int64)


def indel_many(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """:func:`indel` of each pair; not a number where one is null. Pairs of like lengths are compared together."""
    out = np.full(len(a), np.nan)
    many = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x is None or y is None:
            continue
        if x and y and len(x) <= _WIDE and len(y) <= _WIDE:
            many.append(i)
        else:
            out[i] = indel(x, y)
    many.sort(key=lambda i: (len(a[i]), len(b[i])))
    step = max(1, _CELLS // _WIDE)
    for lo in range(0, len(many), step):
        at = many[lo : lo + step]
        x, y = [a[i] for i in at], [b[i] for i in at]
        total = np.fromiter((len(p) + len(q) for p, q in zip(x, y, strict=True)), float, len(at))
        out[at] = 1 - (total - 2 * _lcs_many(x, y)) / total
    return out


@F.arrow_udf(DoubleType())
def indel_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    out = indel_many(a.to_pylist(), b.to_pylist())
    return pa.array(out, pa.float64(), mask=np.isnan(out))


def round_ratio(v: Column) -> Column:
    return F.floor(v * 1e6 + 0.5) / 1e6


def bounded_int(v: Column, least: int, most: int, fallback: int) -> Column:
    """A trimmed integer of at most 15 digits within bounds; anything else is the fallback."""
    t = F.trim(text_of(v))
    return F.when(t.rlike(r"^[+-]?\d{1,15}$"), F.greatest(F.lit(least), F.least(F.lit(most), t.cast("long")))).otherwise(F.lit(fallback)).cast("long")


def non_negative_int(v: Column) -> Column:
    t = F.trim(text_of(v))
    return F.when(t.rlike(r"^\d{1,15}$"), t.cast("long"))
