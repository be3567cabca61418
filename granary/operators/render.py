"""Notation in rows and in text, and back from text.

A printed line is a row of parallel arrays, one place a beat. The text form writes a note as its letter (lower case for
flat notes, m for the sharp one), its octave, its grace note in braces; holds, rests and unread beats are signs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from html import escape
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from granary.operators.notation import fill_defaults

# Signs of the text form.
HOLD, REST, UNREAD, SHAKE, BAR, END = "-", "*", "?", "~", "|", "||"
# Marks of a cycle, and the classes of octaves on a page.
SAM, KHALI = "×", "0"
OCTAVE_CLASSES = {2: ("n-taar2",), 1: ("n-taar",), -1: ("n-mandra",), -2: ("n-mandra2",)}
_NOTE = re.compile(r"(?:\{(?P<kan>[A-Za-z][',]*)\})?(?P<letter>[SRGMPDNsrgmpdn])(?P<octave>[',]*)(?P<shake>~?)(?P<hold>-*)")


@dataclass(frozen=True)
class Taal:
    matras: int
    vibhag: Sequence[int]
    marks: Sequence[str | None]

    @property
    def starts(self) -> frozenset[int]:
        return frozenset(accumulate(self.vibhag[:-1], initial=1))

    def mark(self, beat: int) -> str | None:
        order = sorted(self.starts)
        return self.marks[order.index(beat)] if beat in self.starts and order.index(beat) < len(self.marks) else None


@dataclass(frozen=True)
class Script:
    """How swaras are written in another script, by swara, and its signs."""

    letters: Mapping[str, str] = field(default_factory=dict)
    hold: str = "—"
    komal: str = "̲"
    tivra: str = "́"
    high: str = "̇"
    low: str = "̣"


def note_text(note: Mapping[str, Any], script: Script | None = None) -> str:
    octave = note.get("o") or 0
    if script is None:
        sharp = note.get("t") and note["s"] == "M"
        letter = note["s"].lower() if sharp or note.get("k") and note["s"] in "RGDN" else note["s"]
        out = letter + ("'" if octave > 0 else ",") * abs(octave)
    else:
        out = script.letters[note["s"]] + script.komal * bool(note.get("k")) + script.tivra * bool(note.get("t")) + (script.high if octave > 0 else script.low) * abs(octave)
    kan = note.get("kan")
    grace = "{" + note_text({**kan, "kan": None, "kh": False}, script) + "}" if kan else ""
    return grace + out + SHAKE * bool(note.get("kh"))


def beat_text(beat: Mapping[str, Any], script: Script | None = None) -> str:
    if beat.get("ext"):
        return HOLD if script is None else script.hold
    if beat.get("rest"):
        return REST
    if beat.get("notes") is None:
        return UNREAD
    return "".join(note_text(n, script) + HOLD * ((n.get("len") or 1) - 1) for n in beat["notes"])


def bol_text(beat: Mapping[str, Any], spelled: str | None = None, sign: str = HOLD) -> str:
    bol = beat.get("bol")
    return "" if not bol else (bol.get("g") or "" if spelled is None else spelled) + sign * (bol.get("h") or 0)


def word_spans(text: str) -> list[tuple[int, int]]:
    """[start, end) of each word; counters and the refrain's marker between dandas are none."""
    out = []
    for part in re.finditer("[^।॥]+", text):
        if part[0].strip() and not re.fullmatch(r"[੦-੯0-9\s]+", part[0]) and not re.fullmatch(r"\s*ਰਹਾਉ(\s+ਦੂਜਾ)?\s*", part[0]):
            out += [(part.start() + w.start(), part.start() + w.end()) for w in re.finditer(r"\S+", part[0])]
    return out


def word_spans_column(text: Column) -> Column:
    """array<struct<start, end>> of :func:`word_spans`; a null text has none."""
    kind = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    run = lambda col: pa.array([[{"start": a, "end": b} for a, b in word_spans(t or "")] for t in col.to_pylist()], arrow)
    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR)(text)


@dataclass(frozen=True)
class Roman:
    """Latin spellings of a script's parts: consonants (dotted ones as two characters), vowel signs, independent vowels,
    nasal signs, consonants under another (with the joining sign before them), and the vowel that no sign writes."""

    consonants: Mapping[str, str]
    signs: Mapping[str, str]
    independent: Mapping[str, str]
    nasal: Mapping[str, str]
    subjoined: Mapping[str, str]
    inherent: str
    joiner: str = "੍"
    doubler: str = "ੱ"
    silent: str = "ੁਿ"

    def of(self, text: str | None) -> str:
        """A consonant sounds with its sign, or the unwritten vowel unless it ends the text; the last short sign is silent; a
        doubler gives the vowel and the next consonant's first letter. What no table has is left out."""
        one = "|".join(sorted(map(re.escape, self.consonants), key=len, reverse=True))
        syllable = re.compile(f"({one})((?:{self.joiner}(?:{one}))*)|(.)", re.S)
        out, at, text = [], 0, text or ""
        while m := syllable.match(text, at):
            at = m.end()
            if m[3]:
                out.append(next((t[m[3]] for t in (self.independent, self.nasal, self.signs) if m[3] in t), ""))
                continue
            out.append(self.consonants[m[1]])
            out += [self.subjoined.get(x[0], self.consonants[x[1]]) for x in re.finditer(f"{self.joiner}({one})", m[2])]
            after = text[at : at + 1]
            if after in self.signs:
                at += 1
                out.append("" if after in self.silent and at == len(text) else self.signs[after])
            elif after == self.doubler:
                at += 1
                ahead = re.match(one, text[at:])
                out.append(self.inherent + (self.consonants[ahead[0]][0] if ahead else ""))
            elif after:
                out.append(self.inherent)
        return "".join(out)


def roman_column(text: Column, roman: Roman) -> Column:
    return F.arrow_udf(lambda col: pa.array([roman.of(t) for t in col.to_pylist()], pa.string()), StringType(), F.ArrowUDFType.SCALAR)(text)


def spelled_bols(beats: Sequence[Mapping[str, Any]], text: str | None, roman: str | None) -> list[str | None]:
    """The Latin word under each beat, by its span in the line; none unless both texts have as many words."""
    spans, words = word_spans(text or ""), (roman or "").split()
    by_span = dict(zip(spans, words, strict=True)) if spans and len(spans) == len(words) else {}
    return [by_span.get(tuple((b.get("bol") or {}).get("span") or ())) for b in beats]


def spelled_column(spans: Column, text: Column, roman: Column) -> Column:
    """array<string>: for each span [start, end] the Latin word that stands for the word there, or null."""

    def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        rows = zip(a.to_pylist(), b.to_pylist(), c.to_pylist(), strict=True)
        return pa.array([spelled_bols([{"bol": {"span": s}} for s in spans or ()], t, r) for spans, t, r in rows], pa.list_(pa.string()))

    return F.arrow_udf(run, ArrayType(StringType()), F.ArrowUDFType.SCALAR)(spans, text, roman)


def grid(record: Mapping[str, Any], taals: Mapping[str, Taal], lines: Mapping[int, tuple[str, str]] | None = None, script: Script | None = None) -> Iterator[dict[str, Any]]:
    """A row for each printed line."""
    heading = (record.get("heading") or {}).get("taal") or {}
    for section in fill_defaults(dict(record)).get("sections") or []:
        own = section.get("taal")
        key = own if isinstance(own, str) else (own or heading).get("key")
        taal = taals.get(key)
        for line in section.get("lines") or []:
            beats, free = line.get("beats") or [], line.get("kind") == "free"
            places = range(line["matra_from"], line["matra_from"] + len(beats))
            spelled = spelled_bols(beats, *(lines or {}).get(line.get("line_id"), (None, None)))
            yield {
                "section": section.get("kind"), "n": section.get("n"), "label": section.get("label"), "kind": line.get("kind"), "avartan": line.get("avartan"), "matra_from": line["matra_from"], "taal": key, "continues": bool(line["continues"]),
                "matras": [None if free else b.get("m") for b in beats],
                "marks": [None if free or taal is None else taal.mark(p) for p in places],
                "vibhag": [not free and taal is not None and b.get("m") in taal.starts for b in beats],
                "swar": [beat_text(b) for b in beats],
                "swar_native": [beat_text(b, script) for b in beats] if script else [],
                "bol": [bol_text(b, s) for b, s in zip(beats, spelled, strict=True)],
                "unread": ["notes" in b and b["notes"] is None for b in beats],
                "has_bol": any("bol" in b for b in beats), "beats": beats,
            }


def line_text(row: Mapping[str, Any]) -> str:
    cells = [x for i, c in enumerate(row["swar"]) for x in ([BAR, c] if row["vibhag"][i] and i else [c])]
    if row["kind"] != "avartan":
        return " ".join(cells)
    return " ".join([*([f"@{row['matra_from']}"] if row["matra_from"] != 1 else []), *cells, END])


def text(record: Mapping[str, Any], taals: Mapping[str, Taal], lines: Mapping[int, tuple[str, str]] | None = None, script: Script | None = None) -> str:
    """A record as text; with a ``script`` its notes are written in that, and bols as the record has them."""
    out, before = [], None
    for row in grid(record, taals, lines, script):
        row = row if script is None else row | {"swar": row["swar_native"]}
        head = (row["section"], row["n"])
        if head != before:
            out.append(f"[{row['section']}{' ' + str(row['n']) if row['n'] else ''}]")
            before = head
        out.append(line_text(row))
        if row["has_bol"]:
            out.append("  " + " ".join(b or "." for b in row["bol"]))
    return "\n".join(out)


def _octave(marks: str) -> int:
    return marks.count("'") - marks.count(",")


def _letter(c: str) -> dict[str, Any]:
    return {"s": c.upper()} | ({} if c.isupper() else {"t": True} if c == "m" else {"k": True})


def parse_cell(cell: str) -> dict[str, Any]:
    """The beat that a cell writes. ValueError if it can't be read."""
    signs = {HOLD: {"ext": True}, REST: {"rest": True}, UNREAD: {"notes": None}}
    if cell in signs:
        return signs[cell]
    notes, at = [], 0
    while at < len(cell):
        m = _NOTE.match(cell, at)
        if not m:
            raise ValueError(f"cell {cell!r} can't be read from character {at} on")
        parts = [("o", _octave(m["octave"])), ("kan", m["kan"] and _letter(m["kan"][0]) | ({"o": _octave(m["kan"])} if _octave(m["kan"]) else {})), ("kh", bool(m["shake"])), ("len", len(m["hold"]) + 1 if m["hold"] else 0)]
        notes.append(_letter(m["letter"]) | {k: v for k, v in parts if v})
        at = m.end()
    length = sum(n.get("len", 1) for n in notes)
    return {"notes": notes} | ({"div": length} if length != 1 else {})


def parse_line(line: str) -> dict[str, Any]:
    body = line.strip()
    cells = [c for c in body.removesuffix(END).split() if c != BAR]
    start = int(cells.pop(0)[1:]) if cells and re.fullmatch(r"@\d+", cells[0]) else 1
    return {"kind": "avartan" if body.endswith(END) else "free", "matra_from": start, "beats": [parse_cell(c) for c in cells]}


def _tag(name: str, body: str, classes: Sequence[str] = (), **data: object) -> str:
    pairs = [("class", " ".join(classes))] * bool(classes) + [(k if k == "title" else f"data-{k}", v) for k, v in data.items()]
    return "<" + name + "".join(f' {k}="{escape(str(v))}"' for k, v in pairs) + f">{body}</{name}>"


def _note_html(note: Mapping[str, Any], script: Script | None) -> str:
    octave, length = note.get("o") or 0, note.get("len") or 1
    classes = ["n", *(c for c, on in (("n-komal", note.get("k")), ("n-tivra", note.get("t"))) if on), *OCTAVE_CLASSES.get(max(-2, min(2, octave)), ())]
    classes += ["n-khatka"] * bool(note.get("kh")) + [f"n-len-{length}"] * (length > 1)
    letter = lambda x: note_text({**x, "kan": None, "kh": False}) if script is None else script.letters[x["s"]]
    grace = _tag("sup", escape(letter(note["kan"])), ["n-kan"]) if note.get("kan") else ""
    return grace + _tag("span", escape(letter(note)), classes, s=note["s"]) + HOLD * (length - 1)


def _beat_html(beat: Mapping[str, Any], script: Script | None) -> str:
    if beat.get("ext"):
        return _tag("span", HOLD if script is None else script.hold, ["n", "n-ext"])
    if beat.get("rest"):
        return _tag("span", REST, ["n", "n-rest"])
    notes = beat.get("notes")
    if notes is None:
        return _tag("span", UNREAD, ["n", "n-unknown"], title=beat.get("raw") or "")
    body = "".join(_note_html(n, script) for n in notes)
    return _tag("span", body, ["n-grp", f"n-grp-{min(len(notes), 4)}"]) if len(notes) > 1 else body


def _bol_html(bol: str) -> str:
    said = bol.rstrip(HOLD)
    return escape(said) + (_tag("span", bol[len(said) :], ["b-held"]) if len(said) < len(bol) else "")


def _line_html(row: Mapping[str, Any], script: Script | None, matras: bool) -> str:
    free = row["kind"] == "free"
    kinds = {SAM: "ntn-sam", KHALI: "ntn-khali"}
    cells = [["ntn-cell", *["ntn-vb"] * v, *([kinds.get(m, "ntn-tali")] if m is not None else []), *["ntn-unknown"] * u] for v, m, u in zip(row["vibhag"], row["marks"], row["unread"], strict=True)]
    places = ["" if m is None else str(m) for m in row["matras"]]

    def tr(kind: str, bodies: Sequence[str], cell: str = "td", numbered: bool = False) -> str:
        made = [_tag(cell, b, c, **({"m": p} if numbered else {})) for b, c, p in zip(bodies, cells, places, strict=True)]
        return _tag("tr", "".join(made), ["ntn-row", f"ntn-row-{kind}"])

    rows = [tr("m", places, "th")] if matras and not free else []
    rows.append(tr("swar", [_beat_html(b, script) for b in row["beats"]], numbered=True))
    rows += [tr("bol", [_bol_html(b) for b in row["bol"]])] * row["has_bol"]
    rows += [tr("mark", [escape(m or "") for m in row["marks"]])] * (not free and any(m is not None for m in row["marks"]))
    return _tag("table", "".join(rows), ["ntn-line", *["ntn-free"] * free, *["ntn-cont"] * row["continues"]], kind=row["kind"], taal=row["taal"] or "", **{"from": row["matra_from"]})


def html(record: Mapping[str, Any], taals: Mapping[str, Taal], lines: Mapping[int, tuple[str, str]] | None = None, script: Script | None = None, matras: bool = True) -> str:
    """A record as a part of a page: a block a section, a table a line with rows of beats' numbers, swaras, bols and marks."""
    sections: list[tuple[tuple[Any, Any], str, list[str]]] = []
    for row in grid(record, taals, lines, script):
        key = (row["section"], row["n"])
        if not sections or sections[-1][0] != key:
            sections.append((key, row["label"] or row["section"] or "", []))
        sections[-1][2].append(_line_html(row, script, matras))
    made = [_tag("div", _tag("div", escape(label), ["ntn-sec-label"]) + "".join(tables), ["ntn-sec"], kind=kind, n=n or "") for (kind, n), label, tables in sections]
    return _tag("div", "".join(made), ["ntn"], id=record.get("notation_id") or "", script="english" if script is None else "gurmukhi")


def pages(records: DataFrame, key: str, body: str, taals: Mapping[str, Taal], script: Script | None = None) -> DataFrame:
    """(id, html) of each record."""
    return _each(records, key, body, "html", lambda r: html(r, taals, script=script))


def _each(records: DataFrame, key: str, body: str, name: str, one: Callable[[dict[str, Any]], str]) -> DataFrame:
    run = lambda col: pa.array([None if v is None else one(json.loads(v)) for v in col.to_pylist()], pa.string())
    return records.select(F.col(key).cast("string").alias("id"), F.arrow_udf(run, StringType(), F.ArrowUDFType.SCALAR)(F.col(body)).alias(name))


def texts(records: DataFrame, key: str, body: str, taals: Mapping[str, Taal], script: Script | None = None) -> DataFrame:
    """(id, text) of each record."""
    return _each(records, key, body, "text", lambda r: text(r, taals, script=script))


def parsed(rows: DataFrame, key: str, line: str) -> DataFrame:
    """(id, kind, matra_from, pos, s, o, k, t, ext, rest, error) of every beat that a printed line writes; a beat with several notes has
    as many rows. A line that can't be read is a row with what is wrong with it, and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "kind", "matra_from", "pos", "s", "o", "k", "t", "ext", "rest", "error"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.bool_()] * 4, pa.string()]
        for batch in batches:
            out = []
            for name, printed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    p = parse_line(printed or "")
                except (ValueError, KeyError, IndexError) as why:
                    out.append((name, *[None] * 9, str(why) or type(why).__name__))
                    continue
                for i, beat in enumerate(p["beats"]):
                    for n in beat.get("notes") or [{}]:
                        out.append((name, p["kind"], p["matra_from"], i, n.get("s"), n.get("o", 0), n.get("k", False), n.get("t", False), beat.get("ext", False), beat.get("rest", False), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 11, kinds, strict=True)], names)

    return rows.select(F.col(key).cast("string"), line).mapInArrow(run, "id string, kind string, matra_from int, pos int, s string, o int, k boolean, t boolean, ext boolean, rest boolean, error string")


_GRID = "id string, ord int, section string, n int, kind string, matra_from int, taal string, swar array<string>, marks array<string>, vibhag array<boolean>, bol array<string>, line string"


def cells(records: DataFrame, key: str, body: str, taals: Mapping[str, Taal]) -> DataFrame:
    """The rows of :func:`grid` for a column of records; lines of one record are numbered by ``ord``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"id": k, "ord": i, **row, "line": line_text(row)} for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if v is not None for i, row in enumerate(grid(json.loads(v), taals))]
            strings = pa.list_(pa.string())
            kinds = {"id": pa.string(), "ord": pa.int32(), "section": pa.string(), "n": pa.int32(), "kind": pa.string(), "matra_from": pa.int32(), "taal": pa.string(), "swar": strings, "marks": strings, "vibhag": pa.list_(pa.bool_()), "bol": strings, "line": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], list(kinds))

    return records.select(F.col(key).cast("string"), body).mapInArrow(run, _GRID)
