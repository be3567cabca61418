"""The on-screen keyboard for first letters, and what physical keys write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.letters import LETTERS, typed_keys

# Rows of letters (five of LETTERS each), dotted letters, signs; the sound of each letter; the letter that a
# Latin key sounds like.
DOTTED_ROW = ["ਸ਼", "ਖ਼", "ਗ਼", "ਜ਼", "ਫ਼", "ਲ਼"]
SIGN_ROW = ["ਾ", "ਿ", "ੀ", "ੁ", "ੂ", "ੇ", "ੈ", "ੋ", "ੌ", "ੰ", "ੱ", "ਂ", "਼"]
SOUNDS = "u a i s h k kh g gh ng ch chh j jh ny T Th D Dh N t th d dh n p ph b bh m y r l v R".split()
DOTTED_SOUNDS = "sh khh ghh z f L".split()
SOUND_KEYS = {"u": "ੳ", "a": "ਅ", "i": "ੲ", "e": "ੲ", "o": "ਓ", "s": "ਸ", "h": "ਹ", "k": "ਕ", "K": "ਖ", "g": "ਗ", "G": "ਘ", "c": "ਚ", "C": "ਛ", "j": "ਜ", "J": "ਝ", "T": "ਟ", "D": "ਡ", "N": "ਣ", "R": "ੜ", "t": "ਤ", "d": "ਦ", "n": "ਨ", "p": "ਪ", "P": "ਫ", "b": "ਬ", "B": "ਭ", "m": "ਮ", "y": "ਯ", "r": "ਰ", "l": "ਲ", "v": "ਵ", "w": "ਵ", "f": "ਫ਼", "z": "ਜ਼", "S": "ਸ਼"}


def keys() -> list[tuple[int, int, str, str, str]]:
    """(row, place, letter, sound, key) of every key that writes a letter; dotted letters have their base's key."""
    plain = [(i // 5, i % 5, c, s) for i, (c, s) in enumerate(zip(LETTERS, SOUNDS, strict=True))]
    dotted = [(len(LETTERS) // 5, i, c, s) for i, (c, s) in enumerate(zip(DOTTED_ROW, DOTTED_SOUNDS, strict=True))]
    return [(r, p, c, s, typed_keys(c)) for r, p, c, s in [*plain, *dotted]]


def physical() -> dict[str, str]:
    """Key -> letter; a base letter comes before the dotted one that folds to it."""
    out: dict[str, str] = {}
    for _, _, letter, _, key in keys():
        if len(key) == 1:
            out.setdefault(key, letter)
    return out


def typed(text: Column) -> Column:
    """What physical keys write: each key's letter; what is on no key stays."""
    own = physical()
    return F.translate(text, "".join(own), "".join(own.values()))


def main_letters(text: Column) -> Column:
    """The letters of a text without signs, dots, spaces and all else."""
    return F.regexp_replace(text, f"[^{LETTERS}]", "")
