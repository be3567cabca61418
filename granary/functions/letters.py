"""First letters of words as fixed-width codes, so that a prefix of letters is a range of strings."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code of a letter -> code of its variant with a dot below, and the letters behind the codes.
VARIANTS = {"103": "090", "106": "122", "115": "083", "075": "094", "080": "038"}
#: Dotted letters -> their base, and the dot itself, which is deleted.
DOTTED = {"ਸ਼": "ਸ", "ਖ਼": "ਖ", "ਗ਼": "ਗ", "ਜ਼": "ਜ", "ਫ਼": "ਫ", "ਲ਼": "ਲ"}
DOT = "਼"
#: The base letters of the script, and the keys that write them.
LETTERS = "ੳਅੲਸਹਕਖਗਘਙਚਛਜਝਞਟਠਡਢਣਤਥਦਧਨਪਫਬਭਮਯਰਲਵੜ"
KEYS = "aAeshkKgG|cCjJ\\tTfFxqQdDnpPbBmXrlvV"
#: What a query may hold that isn't a letter; it is not coded.
OPERATORS = "+-*\"'"


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is worked out once, however often ``f`` names it and wherever a filter is pushed to."""
    return F.transform(F.array(c), f)[0]


def strip_dots(s: Column) -> Column:
    """Both ways of writing a dotted letter give its base; so no normalisation is needed first."""
    return F.replace(F.translate(s, "".join(DOTTED), "".join(DOTTED.values())), F.lit(DOT), F.lit(""))


def to_keys(s: Column) -> Column:
    """Letters of the script to the keys that write them; all else stays."""
    return F.translate(s, LETTERS, KEYS)


def char_codes(s: Column) -> Column:
    """``,`` and the code of each character: three digits, one zero before a code of under 100; operators stay raw."""
    one = lambda c: F.when(F.instr(F.lit(OPERATORS), c) > 0, c).otherwise(F.concat(F.lit(","), F.when(F.ascii(c) < 100, "0").otherwise(""), F.ascii(c).cast("string")))
    return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), one), "")


def query_codes(raw: Column) -> Column:
    """White space goes, dots fold, letters become keys, keys become codes; a null query is empty."""
    return char_codes(to_keys(strip_dots(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", ""))))


def variant_codes(codes: Column) -> Column:
    """The codes with every letter that has a dotted variant replaced by it; null if none has."""
    table = F.create_map(*[F.lit(x) for kv in VARIANTS.items() for x in kv])
    parts = F.transform(F.split(codes, ","), lambda c: F.coalesce(table[c], c))
    return F.nullif(F.array_join(parts, ","), codes)


def suffix_tokens(codes: Column, most: int | None = None) -> Column:
    """Every suffix of a string of codes that starts at a letter, the whole first; of each its first ``most`` letters."""

    def of(parts: Column) -> Column:
        n = F.size(parts)
        length = lambda i: n - i + 1 if most is None else F.least(F.lit(most), n - i + 1)
        made = lambda i: F.concat(F.lit(","), F.array_join(F.slice(parts, i, length(i)), ","))
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), made)).otherwise(F.array().cast("array<string>"))

    # the parts are bound once; written in place they would be worked out again for every suffix
    return F.transform(F.array(F.filter(F.split(codes, ","), lambda c: c != "")), of)[0]


def match_start(letters: Column, query: Column) -> Column:
    """Place, from 0, of the first match of a query's keys among a line's; a letter also meets its dotted variant. Null
    if there is none or the query is empty."""
    direct = F.instr(letters, query)
    pairs = {chr(int(a)): chr(int(b)) for a, b in VARIANTS.items()}
    pairs |= {b: a for a, b in pairs.items()}
    either = F.create_map(*[F.lit(x) for a, b in pairs.items() for x in (a, f"[{re.escape(a)}{re.escape(b)}]")])
    pattern = F.array_join(F.transform(F.split(query, ""), lambda c: F.coalesce(either[c], F.regexp_replace(c, r"([^A-Za-z0-9])", r"\\$1"))), "")
    loose = F.regexp_instr(letters, pattern)
    return F.when(query == "", None).when(direct > 0, direct - 1).when(loose > 0, loose - 1).otherwise(None)


def match_span(letters: Column, query: Column) -> Column:
    """struct(start, length) or null."""
    at = match_start(letters, query)
    return F.when(at.isNotNull(), F.struct(at.alias("start"), F.length(query).alias("length")))


def upper_bound(codes: Column) -> Column:
    """The end of the range of strings that start with ``codes``: codes have a fixed width and start with a comma."""
    return F.concat(codes, F.lit(",z"))


def has_operator(s: Column) -> Column:
    return F.coalesce(s, F.lit("")).rlike("[" + re.escape(OPERATORS) + "]")


def letters_of_words(line: Column) -> Column:
    """:func:`word_letters` as an expression."""

    def one(w: Column) -> Column:
        bare = F.regexp_replace(w, "^i+", "")
        return F.when(bare.rlike(r"^[\]0-9\[]") | (bare == "") | (w == "rhwau"), "").otherwise(F.substring(bare, 1, 1))

    return F.transform(F.filter(F.split(F.coalesce(line, F.lit("")), r"\s+"), lambda w: w != ""), one)


def word_of_letter(words: Column) -> Column:
    """For each letter, the place of the word that it is from."""
    return F.flatten(F.transform(words, lambda w, i: F.array_repeat(i, F.length(w))))


def highlight_words(line: Column, query: Column) -> Column:
    """struct(first, last): the words, both included, of the first match of a query's keys among the line's letters."""
    words = letters_of_words(line)
    at = match_start(F.array_join(words, ""), query)
    place = word_of_letter(words)
    return F.when(at.isNotNull(), F.struct(F.get(place, at).alias("first"), F.get(place, at + F.length(query) - 1).alias("last")))


def word_letters(line: str) -> list[str]:
    """Each word's first letter as typed: a vowel sign that is typed before its consonant, counters and the refrain's
    marker count for nothing."""
    out = []
    for w in line.split():
        bare = w.lstrip("i")
        if not bare or bare[0] in "]0123456789[" or w == "rhwau":
            out.append("")
        else:
            out.append(bare[0])
    return out


def typed_keys(query: str | None) -> str:
    """A query's letters as keys: white space goes, dots fold, letters of the script become the keys that write them."""
    bare = unicodedata.normalize("NFC", query or "").replace(DOT, "")
    return "".join(DOTTED.get(c, c) for c in bare if not c.isspace()).translate(str.maketrans(LETTERS, KEYS))


def highlight(line: str | None, letters: str | None, query: str | None) -> tuple[int, int] | None:
    """First and last word, inclusive, of the first match of a query's letters in a line; None if there is none."""
    typed = typed_keys(query)
    if not line or not letters or not typed:
        return None
    pairs = {chr(int(a)): chr(int(b)) for a, b in VARIANTS.items()}
    pairs |= {b: a for a, b in pairs.items()}
    same = lambda at: all(a == b or pairs.get(a) == b for a, b in zip(letters[at : at + len(typed)], typed, strict=False))
    at = letters.find(typed)
    if at < 0:
        at = next((i for i in range(len(letters) - len(typed) + 1) if same(i)), -1)
    words = [i for i, x in enumerate(word_letters(line)) for _ in x]
    last = at + len(typed) - 1
    return (words[at], words[last]) if 0 <= at and last < len(words) else None
