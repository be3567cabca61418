"""Nested notation records: levels as tables, rules as expressions over them.

A record is JSON. Its sections, lines, beats and notes become rows of four tables with the path of each, so a rule is a
condition on a row, and rules that look at what stands before (the count of matras, spans that must not overlap) are
windows. What is absent and what is null differ: the keys of an object are kept beside its values.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

# What the fields of a record may say.
SCHEMA_VERSION = 1
KINDS = ["notation", "partial", "reet-ref", "non-gurbani"]
SCRIPTS = ["gurmukhi", "latin", "devanagari"]
SECTION_KINDS = ["sthai", "antara", "sanchari", "abhog", "alaap", "taan", "tihai", "other"]
LINE_KINDS = ["avartan", "free"]
DIVS = [1, 2, 3, 4, 6, 8]
SOURCES = ["G", "D", "B", "K", "N"]
METHODS = ["stream+ref+bol", "stream+ref", "stream+bol", "stream", "ref-window", "ref+bol", "bol", "book-ref", "index", "manual", "none"]
FLAGS = [
    "unresolved-shabad", "weak-shabad", "ref-conflict", "no-shabad-text", "no-section-label",
    "taal-mismatch", "taal-unknown", "raag-unknown", "style-contradiction", "continues-next-page",
    "continued-from-prev", "empty-beat", "unread-cell", "tick-on-non-ma", "diagonal-watermark",
    "partial-grid", "unmatched-text", "taal-changes", "raag-differs", "shabad-by-book-ref",
    "shabad-inherited", "span-capped", "shabad-by-bol", "shabad-by-index", "index-conflict", "long-span",
]
SWARAS, KOMAL, TIVRA = ["S", "R", "G", "M", "P", "D", "N"], ["R", "G", "D", "N"], ["M"]
NOTE_DEFAULTS = {"o": 0, "k": False, "t": False, "len": 1, "kh": False}
LINE_DEFAULTS = {"matra_from": 1, "continues": False}
BEAT_DEFAULTS = {"div": 1}

_RECORD = "schema_version string, notation_id string, book_key string, page int, seq int, kind string, script string, pages array<int>, flags array<string>, raag_shabad string, heading string, shabad string, sections array<string>"
_LINE = "kind string, matra_from int, line_id bigint, beats array<string>"
_BEAT = "m int, div int, ext boolean, rest boolean, raw string, c double, notes array<string>, bol string"
_FOUND = "array<struct<code:string,path:string>>"
_NOTE = "s string, o string, k boolean, t boolean, len string, kh boolean, kan string"


def _at(root: Column, *steps: Any) -> Column:
    return F.concat(*[s if isinstance(s, Column) else F.lit(s) for s in (root, *steps)])


def _has(obj: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(obj), key), F.lit(False))


def levels(records: DataFrame, key: str, body: str, rules: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> dict[str, DataFrame]:
    """The tables ``record``, ``section``, ``line``, ``beat`` and ``note``, each with (key, path) and its level's values.

    ``rules`` give each level's table a column ``own``, an array. The tables then have outer rows too, and ``found``: what the row's own
    rules and those of the levels above give, the latter once only, on the first row below. So ``note`` has all, from one reading.
    """
    below = F.posexplode_outer if rules else F.posexplode
    kept = ["found"] if rules else []

    def told(level: str, table: DataFrame, pos: str | None = None) -> DataFrame:
        if not rules:
            return table
        table, none = rules[level](table), F.array().cast(_FOUND)
        if pos is None:
            return table.withColumnRenamed("own", "found")
        above = F.when(F.col(pos).isNull() | (F.col(pos) == 0), F.col("found")).otherwise(none)
        return table.withColumn("found", F.concat(above, F.when(F.col(pos).isNotNull(), F.col("own")).otherwise(none))).drop("own")

    record = records.select(key, F.col(body).alias("json"), F.from_json(body, _RECORD).alias("r"))
    record = record.withColumn("taal_key", F.get_json_object("r.heading", "$.taal.key")).withColumn("taal_matras", F.get_json_object("r.heading", "$.taal.matras").try_cast("int"))
    record = record.withColumn("has_taal", F.get_json_object("r.heading", "$.taal").isNotNull())
    record = told("record", record)
    section = record.select(key, *kept, "taal_key", "taal_matras", "has_taal", below("r.sections").alias("si", "json"))
    own = F.coalesce(F.get_json_object("json", "$.taal.key"), F.get_json_object("json", "$.taal"))
    section = section.select(
        key, *kept, "si", "json", _at(F.lit("sections["), F.col("si").cast("string"), "]").alias("path"),
        F.get_json_object("json", "$.kind").alias("kind"), F.get_json_object("json", "$.n").try_cast("int").alias("n"), own.alias("own_taal"),
        F.coalesce(own, "taal_key").alias("taal"), F.when(own.isNull(), F.col("taal_matras")).alias("matras"), (own.isNotNull() | F.col("has_taal")).alias("has_taal"),
        F.from_json("json", "lines array<string>")["lines"].alias("lines"),
    )
    section = told("section", section, "si")
    line = section.select(key, *kept, "si", "taal", "matras", "has_taal", below("lines").alias("li", "json"), F.col("path").alias("up"))
    line = line.select(key, *kept, "si", "li", "taal", "matras", "has_taal", _at(F.col("up"), ".lines[", F.col("li").cast("string"), "]").alias("path"), F.from_json("json", _LINE).alias("l"))
    line = told("line", line, "li")
    beat = line.select(key, *kept, "si", "li", below("l.beats").alias("bi", "json"), F.col("path").alias("line_path"), "taal", "matras", F.col("l.kind").alias("line_kind"), F.coalesce("l.matra_from", F.lit(1)).alias("matra_from"), F.col("l.line_id").alias("line_id"))
    beat = beat.withColumn("path", _at(F.col("line_path"), ".beats[", F.col("bi").cast("string"), "]")).withColumn("b", F.from_json("json", _BEAT)).withColumn("has_notes", _has(F.col("json"), "notes")).withColumn("has_m", _has(F.col("json"), "m"))
    beat = told("beat", beat, "bi")
    note = beat.select(key, *kept, F.col("path").alias("up"), below("b.notes").alias("ni", "json"))
    note = note.select(key, *kept, "ni", "up", "json", _at(F.col("up"), ".notes[", F.col("ni").cast("string"), "]").alias("path"), F.from_json("json", _NOTE).alias("x"))
    note = told("note", note, "ni")
    return {"record": record, "section": section, "line": line, "beat": beat, "note": note}


def _own(rules: list[tuple[str, Column, Column]]) -> Column:
    """(code, path) of every rule whose condition holds, in an array."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(code).alias("code"), path.alias("path"))) for code, cond, path in rules])).cast(_FOUND)


def _broken(table: DataFrame, key: str, found: Column) -> DataFrame:
    return table.select(key, F.explode(found).alias("e")).select(key, "e.code", "e.path")


def _not_in(c: Column, values: list[Any]) -> Column:
    return c.isNull() | ~c.isin(*values)


def _whole(c: Column) -> Column:
    return c.rlike(r"^-?\d+$")


def validate(records: DataFrame, key: str, body: str, raags: DataFrame, taals: DataFrame) -> DataFrame:
    """(key, code, path) of every rule that a record breaks; none for a sound one.

    ``raags`` (key) and ``taals`` (key, matras) are the vocabulary. Equal codes at one path are told once.
    """
    raag_keys, taal_keys = (F.broadcast(v.agg(F.coalesce(F.collect_set("key"), F.array().cast("array<string>")).alias(n))) for v, n in ((raags, "raag_keys"), (taals, "taal_keys")))  # vocabularies of some hundreds
    known = lambda df: df.crossJoin(raag_keys).crossJoin(taal_keys)
    missing = lambda c, names: c.isNotNull() & ~F.array_contains(names, c)
    r = F.col("r")
    at = F.lit
    same_id = F.format_string("%s:%04d:%d", r["book_key"], r["page"], r["seq"])
    raag, shabad = F.get_json_object(r["heading"], "$.raag.key"), r["shabad"]
    method, source = F.get_json_object(shabad, "$.method"), F.get_json_object(shabad, "$.source")
    no_sections = F.coalesce(F.size(r["sections"]) <= 0, F.lit(True))
    of_record = _own(
        [
            ("schema.version", F.coalesce(r["schema_version"] != str(SCHEMA_VERSION), at(True)), at("schema_version")),
            ("id.format", F.coalesce(~r["notation_id"].rlike(r"^[a-z0-9]+(-[a-z0-9]+)*:\d{4}:\d+$") | (r["notation_id"] != same_id), at(True)), at("notation_id")),
            ("enum.kind", _not_in(r["kind"], KINDS), at("kind")),
            ("enum.script", _not_in(r["script"], SCRIPTS), at("script")),
            ("pages.list", F.coalesce(~F.array_contains(r["pages"], r["page"]), at(True)), at("pages")),
            ("flags.unknown", F.exists(r["flags"], lambda f: ~f.isin(*FLAGS)), at("flags")),
            ("vocab.key", missing(raag, F.col("raag_keys")), at("heading.raag.key")),
            ("vocab.key", missing(F.col("taal_key"), F.col("taal_keys")), at("heading.taal.key")),
            ("vocab.key", missing(r["raag_shabad"], F.col("raag_keys")), at("raag_shabad")),
            ("enum.source", source.isNotNull() & ~source.isin(*SOURCES), at("shabad.source")),
            ("enum.method", _not_in(method, METHODS), at("shabad.method")),
            ("shabad.unresolved", F.get_json_object(shabad, "$.shabad_id").isNull() & _not_in(method, ["none", "manual"]), at("shabad")),
            ("sections.empty", no_sections & ((r["kind"] == "notation") | (r["kind"] == "partial") & ~F.coalesce(F.array_contains(r["flags"], "partial-grid"), at(False))), at("sections")),
        ],
    )
    path = F.col("path")
    of_section = _own(
        [
            ("enum.section", _not_in(F.col("kind"), SECTION_KINDS), _at(path, ".kind")),
            ("vocab.key", missing(F.col("own_taal"), F.col("taal_keys")), _at(path, ".taal")),
            ("lines.empty", F.coalesce(F.size("lines") <= 0, at(True)), _at(path, ".lines")),
        ],
    )
    no_beats = F.coalesce(F.size("l.beats") <= 0, at(True))
    of_line = _own(
        [
            ("enum.line", _not_in(F.col("l.kind"), LINE_KINDS), _at(path, ".kind")),
            ("beats.empty", no_beats, _at(path, ".beats")),
            ("line.taal", (F.col("l.kind") == "avartan") & ~no_beats & ~F.col("has_taal"), path),
        ],
    )
    b, json_ = F.col("b"), F.col("json")
    modes = F.col("has_notes").cast("int") + F.coalesce(b["ext"], at(False)).cast("int") + F.coalesce(b["rest"], at(False)).cast("int")
    length = F.aggregate(F.coalesce(b["notes"], F.array().cast("array<string>")), F.lit(0), lambda s, x: s + F.coalesce(F.greatest(F.get_json_object(x, "$.len").try_cast("int"), F.lit(1)), F.lit(1)))
    avartan = F.col("line_kind") == "avartan"
    div = F.when(_has(json_, "div"), b["div"]).otherwise(1)
    of_beat = _own(
        [
            ("beat.exclusive", modes != 1, path),
            ("beat.div", _not_in(div, DIVS), _at(path, ".div")),
            ("beat.unknown_raw", F.col("has_notes") & b["notes"].isNull() & ((F.coalesce(b["raw"], at("")) == "") | b["c"].isNull()), path),
            ("beat.exclusive", F.col("has_notes") & (F.size(b["notes"]) == 0), _at(path, ".notes")),
            ("beat.len_sum", (F.size(b["notes"]) > 0) & (length != div), path),
            ("bol.shape", b["bol"].isNotNull() & ~b["bol"].startswith("{"), _at(path, ".bol")),
            ("bol.shape", _has(b["bol"], "h") & ~F.coalesce(F.get_json_object(b["bol"], "$.h").rlike(r"^\d+$"), at(False)), _at(path, ".bol.h")),
            ("line.matras", ~avartan & F.col("has_m"), _at(path, ".m")),
        ],
    )
    kan = F.struct(F.col("x.kan").alias("json"), _at(path, ".kan").alias("path"), F.from_json("x.kan", _NOTE).alias("x"))
    of_note = lambda df: df.withColumn("kan", F.when(F.col("x.kan").startswith("{"), kan)).withColumn("own", F.concat(_note_rules(F.col("x"), path, json_, False), F.when(F.col("kan").isNull(), F.array().cast(_FOUND)).otherwise(_note_rules(F.col("kan.x"), F.col("kan.path"), F.col("kan.json"), True))))
    rows = {"record": lambda df: known(df).withColumn("own", of_record), "section": lambda df: known(df).withColumn("own", of_section), "line": lambda df: df.withColumn("own", of_line), "beat": lambda df: df.withColumn("own", of_beat), "note": of_note}
    alone = _broken(levels(records, key, body, rows)["note"], key, F.col("found"))
    return alone.unionByName(_looking_back(levels(records, key, body), key, taals)).distinct()


def _looking_back(t: dict[str, DataFrame], key: str, taals: DataFrame) -> DataFrame:
    """The rules that need what stands before. Only the few short values that they look at are brought together."""
    path = F.col("path")
    twice = F.row_number().over(Window.partitionBy(key, "kind", "n").orderBy("si")) > 1
    sections = t["section"].filter("n IS NOT NULL").select(key, "si", "kind", "n").withColumn("twice", twice).withColumn("path", _at(F.lit("sections["), F.col("si").cast("string"), "]"))
    b, at = F.col("b"), F.lit
    bol = F.get_json_object("json", "$.bol.span")
    span, avartan = F.from_json(bol, "array<int>"), F.coalesce(F.col("line_kind") == "avartan", at(False))
    beats = t["beat"].select(key, "si", "li", "bi", b["m"].alias("m"), avartan.alias("avartan"), "matra_from", F.col("line_id").isNull().alias("no_id"), "taal", "matras", span.alias("span"), bol.isNotNull().alias("has_span"))
    w = Window.partitionBy(key, "si", "li").orderBy("bi")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    upward = (F.size("span") == 2) & (F.col("span")[0] < F.col("span")[1])
    before = F.last(F.when(F.col("m").isNotNull(), F.struct("m", "bi")), ignorenulls=True).over(earlier)
    beats = beats.withColumn("before", before).withColumn("ended", F.max(F.when(upward, F.col("span")[1])).over(earlier))
    beats = beats.withColumn("expect", F.coalesce(F.col("before.m") + F.col("bi") - F.col("before.bi"), F.col("matra_from") + F.col("bi")))
    beats = beats.withColumn("final", F.lead("bi").over(Window.partitionBy(key, "si", "li", "taal", "matras").orderBy("bi")).isNull())
    sizes = taals.select(F.col("key").alias("taal"), F.col("matras").alias("size"))
    line = _at(F.lit("sections["), F.col("si").cast("string"), "].lines[", F.col("li").cast("string"), "]")
    beats = beats.join(F.broadcast(sizes), "taal", "left").withColumn("line_path", line).withColumn("path", _at(F.col("line_path"), ".beats[", F.col("bi").cast("string"), "]"))
    fits = upward & F.coalesce(F.col("span")[0] >= F.col("ended"), at(True))
    of_beat = _own(
        [
            ("line.matras", F.col("avartan") & F.coalesce(F.col("m") != F.col("expect"), at(True)), _at(path, ".m")),
            ("bol.span", F.col("has_span") & (F.col("no_id") | ~F.coalesce(fits, at(False))), _at(path, ".bol.span")),
            ("line.matras", F.col("avartan") & F.col("final") & (F.coalesce("m", "expect") > F.coalesce("size", "matras")), F.col("line_path")),
        ],
    )
    return _broken(sections, key, _own([("section.n", F.col("twice"), _at(path, ".n"))])).unionByName(_broken(beats, key, of_beat))


def _note_rules(x: Column, path: Column, json_: Column, kan: bool) -> Column:
    real = x["s"].isin(*SWARAS)
    known = F.coalesce(real, F.lit(False))
    octave = F.when(_has(json_, "o"), _whole(x["o"]) & x["o"].try_cast("int").between(-2, 2)).otherwise(True)
    length = F.when(_has(json_, "len"), _whole(x["len"]) & (x["len"].try_cast("int") >= 1)).otherwise(True)
    kan_wrong = x["kan"].isNotNull() & (~x["kan"].startswith("{") if not kan else F.lit(False))
    rules = [
        ("note.swar", ~known, _at(path, ".s")),
        ("note.komal", known & x["k"] & ~x["s"].isin(*KOMAL), path),
        ("note.tivra", known & x["t"] & ~x["s"].isin(*TIVRA), path),
        ("note.octave", known & ~F.coalesce(octave, F.lit(False)), _at(path, ".o")),
        ("beat.len_sum", known & ~F.coalesce(length, F.lit(False)), _at(path, ".len")),
        ("note.kan", known & kan_wrong, _at(path, ".kan")),
    ]
    if kan:
        rules += [("note.kan", known & _has(json_, "len"), path), ("note.kan", x["kan"].isNotNull(), path)]
    return _own(rules)


def _with_defaults(value: Any, level: str) -> Any:
    """A copy in which what a level leaves out is there; levels know which lists hold the next one."""
    if not isinstance(value, dict):
        return value
    plan = {"record": ({}, "sections", "section"), "section": ({}, "lines", "line"), "line": (LINE_DEFAULTS, "beats", "beat"), "beat": (BEAT_DEFAULTS, "notes", "note"), "note": (NOTE_DEFAULTS, None, None), "kan": ({k: v for k, v in NOTE_DEFAULTS.items() if k != "len"}, None, None)}
    defaults, inner, below = plan[level]
    out = defaults | value
    if inner and isinstance(out.get(inner), list):
        out[inner] = [_with_defaults(x, below) for x in out[inner]]
    if level == "note" and isinstance(out.get("kan"), dict):
        out["kan"] = _with_defaults(out["kan"], "kan")
    return out


def _without_defaults(value: Any, level: str) -> Any:
    filled = _with_defaults({}, level)
    if not isinstance(value, dict):
        return value
    below = {"record": ("sections", "section"), "section": ("lines", "line"), "line": ("beats", "beat"), "beat": ("notes", "note")}.get(level)
    out = {k: v for k, v in value.items() if not (k in filled and filled[k] == v and type(filled[k]) is type(v))}
    if below and isinstance(out.get(below[0]), list):
        out[below[0]] = [_without_defaults(x, below[1]) for x in out[below[0]]]
    if level == "note" and isinstance(out.get("kan"), dict):
        out["kan"] = _without_defaults(out["kan"], "kan")
    return out


def canonical_json(value: Any) -> str:
    """Sorted keys, no spaces, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fill_defaults(record: dict[str, Any]) -> dict[str, Any]:
    return _with_defaults(record, "record")


def strip_defaults(record: dict[str, Any]) -> dict[str, Any]:
    return _without_defaults(record, "record")


def content_hash(record: dict[str, Any]) -> str:
    """What two readings of one notation share: its sections without defaults, its group, raag and taal."""
    heading = record.get("heading") or {}
    kept = {"sections": strip_defaults(record).get("sections"), "shabad_id": (record.get("shabad") or {}).get("shabad_id"), "raag_used": (heading.get("raag") or {}).get("key"), "taal": (heading.get("taal") or {}).get("key")}
    return hashlib.sha1(canonical_json(kept).encode()).hexdigest()


@F.arrow_udf(StringType())
def content_hash_column(body: pa.Array) -> pa.Array:
    return pa.array([None if v is None else content_hash(json.loads(v)) for v in body.to_pylist()], pa.string())
