"""Queries on notation records, vocabularies and tokenizers over whole tables, each with SQL of its own.

Orders are notations: their items, by number, are the beats of one printed line. Parts are texts to look up, with faults that
follow from their keys, so the SQL can say what must be found.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from functools import lru_cache
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions import text as X
from granary.functions import tokenizers as tok
from granary.operators import notation, render, vocab
from granary.plans import tables as T
from granary.plans.records import RECORD, TAALS

BEAT = "sections[0].lines[0].beats[0]"


def _beat(r: dict, i: int = 0) -> dict:
    return r["sections"][0]["lines"][0]["beats"][i]


def _put(at: Callable[[dict], Any], key: Any, value: Any) -> Callable[[dict], None]:
    return lambda r: at(r).__setitem__(key, value)


def _free(r: dict) -> None:
    line = r["sections"][0]["lines"][0]
    line["kind"] = "x"
    for b in line["beats"]:
        del b["m"]


def _only(r: dict, beat: dict) -> None:
    r["sections"][0]["lines"][0]["beats"][0] = beat


def _longer(r: dict) -> None:
    beats = r["sections"][0]["lines"][0]["beats"]
    beats.append({"m": 7, "notes": [{"s": "S"}]})


_TOP = lambda r: r
_SECTION = lambda r: r["sections"][0]
_LINE = lambda r: r["sections"][0]["lines"][0]
_NOTE = lambda r: _beat(r)["notes"][0]
#: What is done to a sound record, and which rules it then breaks, where.
FAULTS: list[tuple[Callable[[dict], Any], list[tuple[str, str]]]] = [
    (lambda r: None, []),
    (_put(_TOP, "schema_version", 2), [("schema.version", "schema_version")]),
    (_put(_TOP, "notation_id", "book:0042:4"), [("id.format", "notation_id")]),
    (_put(_TOP, "kind", "x"), [("enum.kind", "kind")]),
    (_put(_TOP, "script", "runes"), [("enum.script", "script")]),
    (_put(_TOP, "pages", []), [("pages.list", "pages")]),
    (_put(_TOP, "flags", ["nope"]), [("flags.unknown", "flags")]),
    (_put(lambda r: r["heading"]["raag"], "key", "unknown"), [("vocab.key", "heading.raag.key")]),
    (_put(lambda r: r["heading"]["taal"], "key", "unknown"), [("vocab.key", "heading.taal.key")]),
    (_put(lambda r: r["shabad"], "source", "X"), [("enum.source", "shabad.source")]),
    (_put(lambda r: r["shabad"], "method", "x"), [("enum.method", "shabad.method")]),
    (_put(lambda r: r["shabad"], "shabad_id", None), [("shabad.unresolved", "shabad")]),
    (_put(_TOP, "sections", []), [("sections.empty", "sections")]),
    (_put(_SECTION, "kind", "x"), [("enum.section", "sections[0].kind")]),
    (lambda r: r["sections"].append(copy.deepcopy(r["sections"][0])), [("section.n", "sections[1].n")]),
    (_put(_SECTION, "lines", []), [("lines.empty", "sections[0].lines")]),
    (_free, [("enum.line", "sections[0].lines[0].kind")]),
    (_put(_LINE, "beats", []), [("beats.empty", "sections[0].lines[0].beats")]),
    (lambda r: r["heading"].pop("taal"), [("line.taal", "sections[0].lines[0]")]),
    (_put(lambda r: _beat(r, 1), "m", 5), [("line.matras", "sections[0].lines[0].beats[1].m"), ("line.matras", "sections[0].lines[0].beats[2].m")]),
    (lambda r: (_LINE(r).pop("line_id"), _beat(r)["bol"].update(span=[0, 2])), [("bol.span", f"{BEAT}.bol.span")]),
    (lambda r: _only(r, {"m": 1, "ext": True, "rest": True}), [("beat.exclusive", BEAT)]),
    (lambda r: _only(r, {"m": 1, "div": 5, "notes": [{"s": "S"}] * 5}), [("beat.div", f"{BEAT}.div")]),
    (lambda r: _only(r, {"m": 1, "notes": None}), [("beat.unknown_raw", BEAT)]),
    (_put(_beat, "div", 2), [("beat.len_sum", BEAT)]),
    (_put(_beat, "bol", "x"), [("bol.shape", f"{BEAT}.bol")]),
    (_put(_NOTE, "s", "X"), [("note.swar", f"{BEAT}.notes[0].s")]),
    (_put(_NOTE, "k", True), [("note.komal", f"{BEAT}.notes[0]")]),
    (_put(_NOTE, "t", True), [("note.tivra", f"{BEAT}.notes[0]")]),
    (_put(_NOTE, "o", 3), [("note.octave", f"{BEAT}.notes[0].o")]),
    (_put(_NOTE, "kan", {"s": "R", "len": 1}), [("note.kan", f"{BEAT}.notes[0].kan")]),
    (_longer, [("line.matras", "sections[0].lines[0]")]),
    (lambda r: _only(r, {"m": 1, "notes": None, "raw": "q", "c": 0.5}), []),
]


@lru_cache(1)
def _faulty() -> list[tuple[int, str]]:
    out = []
    for i, (change, _) in enumerate(FAULTS):
        record = json.loads(json.dumps(RECORD))
        change(record)
        out.append((i, json.dumps(record)))
    return out


def notation_validate(spark: SparkSession, sf: str) -> DataFrame:
    """A record for every part, with the fault that its key picks: every rule there is."""
    bodies = F.broadcast(spark.createDataFrame(_faulty(), "fault int, body string"))
    rows = T.read(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % len(FAULTS)).cast("int").alias("fault")).join(bodies, "fault")
    raags = spark.createDataFrame([("sarang",)], "key string")
    taals = spark.createDataFrame([(k, t.matras) for k, t in TAALS.items()], "key string, matras int")
    return notation.validate(rows, "p_partkey", "body", raags, taals)


def _notations(spark: SparkSession, sf: str) -> DataFrame:
    """(id, body): each order's items as one line of a cycle of sixteen beats."""
    li = T.read(spark, sf, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    letter = F.substring(F.lit("SRGMPDN"), (F.col("l_partkey") % 7 + 1).cast("int"), F.lit(1))
    kind = F.col("l_quantity").cast("int") % 7
    octave = (F.col("l_suppkey") % 3).cast("int") - 1
    note = F.struct(letter.alias("s"), F.when(octave != 0, octave).alias("o"), F.when((F.col("l_returnflag") == "R") & letter.isin("R", "G", "D", "N"), True).alias("k"), F.when((F.col("l_returnflag") == "R") & (letter == "M"), True).alias("t"))
    bol = F.when(F.col("l_discount") > 0.05, F.struct(F.concat(F.lit("b"), F.col("l_linenumber")).alias("g"), F.lit(0).alias("h")))
    beat = F.struct(F.col("m"), F.when(kind > 1, F.array(note)).alias("notes"), F.when(kind == 0, True).alias("ext"), F.when(kind == 1, True).alias("rest"), bol.alias("bol"))
    beats = li.withColumn("m", place).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(beat)).alias("beats"))  # an order has seven items
    line = F.struct(F.lit("avartan").alias("kind"), "beats")
    section = F.struct(F.lit("sthai").alias("kind"), F.lit(1).alias("n"), F.array(line).alias("lines"))
    raag = F.concat(F.lit("r"), F.col("l_orderkey") % 5)
    heading = F.struct(F.struct(raag.alias("key")).alias("raag"), F.struct(F.lit("teen").alias("key")).alias("taal"))
    body = F.to_json(F.struct(heading.alias("heading"), F.struct(F.col("l_orderkey").alias("shabad_id")).alias("shabad"), F.array(section).alias("sections")))
    return beats.select(F.col("l_orderkey").alias("id"), body.alias("body"))


def notation_cells(spark: SparkSession, sf: str) -> DataFrame:
    c = render.cells(_notations(spark, sf), "id", "body", TAALS)
    marks = F.array_join(F.transform("marks", lambda m: F.coalesce(m, F.lit("_"))), " ")
    return c.select("id", F.array_join("swar", " ").alias("swar"), marks.alias("marks"), F.array_join("bol", " ").alias("bol"), "line")


NATIVE = render.Script({"S": "ਸ", "R": "ਰ", "G": "ਗ", "M": "ਮ", "P": "ਪ", "D": "ਧ", "N": "ਨੀ"})


def notation_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Each record as text, with its swaras in Latin letters and in another script."""
    n = _notations(spark, sf)
    return render.texts(n, "id", "body", TAALS).join(render.texts(n, "id", "body", TAALS, NATIVE).withColumnRenamed("text", "native"), "id")


def notation_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each record as a part of a page."""
    return render.pages(_notations(spark, sf), "id", "body", TAALS)


def notation_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """The beats of every printed line, read back."""
    c = render.cells(_notations(spark, sf), "id", "body", TAALS)
    p = render.parsed(c, "id", "line")
    return p.select("id", F.col("pos").cast("long").alias("pos"), "kind", "s", F.col("o").cast("long").alias("o"), "k", "t", "ext", "rest")


def notation_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return _notations(spark, sf).select("id", notation.content_hash_column(F.col("body")).alias("hash"))


# ---- vocabularies


def _vocabulary(spark: SparkSession, sf: str) -> vocab.Vocabulary:
    names = T.read(spark, sf, "part").select(F.col("p_name").alias("spelling")).distinct()
    return vocab.Vocabulary(names.select(F.xxhash64("spelling").alias("ord"), F.replace("spelling", F.lit(" "), F.lit("_")).alias("key"), "spelling"), stops=("raag",))


def vocab_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Every part's name, spelled in a way that needs one of the steps: alias, joined, skeleton, alike, part of it, none."""
    n = F.col("p_name")
    spelled = [F.concat(F.upper(n), F.lit("!")), F.replace(n, F.lit(" "), F.lit("")), F.translate(n, "aeiou", "eaoui"), F.concat(F.substring(n, F.lit(1), F.length(n) - 1), F.lit("q")), F.concat(F.lit("zz "), n, F.lit(" of")), F.lit("xxxx yy")]
    case = F.col("p_partkey") % 6
    text = F.coalesce(*[F.when(case == i, s) for i, s in enumerate(spelled)])
    asked = T.read(spark, sf, "part").select("p_partkey", text.alias("text"))
    return _vocabulary(spark, sf).lookup(asked, "text", vocab.FUZZY_RAAG).select("p_partkey", "key", F.col("confidence").cast("double").alias("confidence"), "method")


def raag_names(spark: SparkSession, sf: str) -> DataFrame:
    """A name with a variant in brackets: the variant's key, and the name as its parent."""
    other = F.concat(F.split("p_name", " ")[0], F.lit(" ring"))
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Raag "), "p_name", F.lit(" ("), other, F.lit(")"))).otherwise(F.concat(F.lit("Raag "), "p_name"))
    asked = T.read(spark, sf, "part").select(F.col("p_partkey").alias("ord"), text.alias("text"))
    parents = spark.createDataFrame([], "key string, parent string")
    return vocab.normalise_raag(_vocabulary(spark, sf), asked, parents).select(F.col("ord").alias("p_partkey"), "key", "parent", "method")


TEMPI = {"slow": ["vilambit", "vilambit lai"], "fast": ["drut"]}


def taal_tempi(spark: SparkSession, sf: str) -> DataFrame:
    """Names of taals without the tempo that stands with them."""
    p = T.read(spark, sf, "part")
    text = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, " Vilambit Lai").when(F.col("p_size") % 3 == 1, " (drut)").otherwise(" drutam"))
    tempo, rest = vocab.split_tempo(text, TEMPI)
    return p.select("p_partkey", tempo.alias("tempo"), F.trim(rest).alias("rest"))


def taal_names(spark: SparkSession, sf: str) -> DataFrame:
    """The taal, its tempo and its beats of names that are parts' names with a tempo."""
    p = T.read(spark, sf, "part")
    text = F.concat(F.when(F.col("p_size") % 3 == 0, "(Drut) ").otherwise(""), F.upper("p_name"), F.when(F.col("p_size") % 3 == 1, " vilambit").otherwise(""))
    matras = p.select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("key"), F.length("p_name").alias("matras")).distinct().filter("matras <> 10")
    found = vocab.normalise_taal(_vocabulary(spark, sf), p.select(F.col("p_partkey").alias("ord"), text.alias("text")), matras, TEMPI)
    return found.select(F.col("ord").alias("p_partkey"), "key", "tempo", T.shown(F.col("matras")).alias("matras"), "method")


SYMBOLS = {"sam": ["×", "x"], "khali": ["0", "o"], "tali": ["2", "3"]}


def mark_kinds(spark: SparkSession, sf: str) -> DataFrame:
    p = T.read(spark, sf, "part")
    glyph = F.concat(F.lit(" "), F.substring(F.lit("×x0o23?"), (F.col("p_size") % 8 + 1).cast("int"), F.lit(1)), F.lit(" "))
    return p.select("p_partkey", vocab.mark_kind(glyph, SYMBOLS).alias("kind"))


def taal_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Marks of cycles whose parts are as long and as many as a part's numbers say, from some beat on."""
    p = T.read(spark, sf, "part")
    size, n = (F.col("p_size") % 3 + 2).cast("int"), (F.col("p_partkey") % 3 + 2).cast("int")
    marks = F.slice(F.array(*map(F.lit, "x203")), F.lit(1), n - 1)
    m = p.select("p_partkey", F.posexplode(vocab.beat_marks(F.array_repeat(size, n), marks, (F.col("p_size") % 2 + 1).cast("int"), F.lit(5))).alias("pos", "mark"))
    return m.select("p_partkey", F.col("pos").cast("long").alias("pos"), "mark")


def taal_of_marks(spark: SparkSession, sf: str) -> DataFrame:
    """The one taal that fits a part's number of beats and its marks."""
    taals = spark.createDataFrame([("teen", 16, 1, [9], [5, 13], [4] * 4), ("jhap", 10, 1, [6], [3, 8], [2, 3, 2, 3]), ("sul", 10, 1, [3, 9], [5, 7], [2] * 5), ("rupak", 7, None, [1], [4, 6], [3, 2, 2])], "key string, matras int, sam int, khali array<int>, tali array<int>, vibhag array<int>")
    p = T.read(spark, sf, "part")
    marks = F.map_concat(F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit(1), F.lit("sam"))).otherwise(F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>"))), F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit(6), F.lit("khali"))).otherwise(F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>"))))
    beats = F.element_at(F.array(F.lit(16), F.lit(10), F.lit(7)), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = p.select(F.col("p_partkey").alias("id"), beats.alias("beats"), marks.alias("marks"))
    return vocab.taal_of_marks(taals, rows).select(F.col("id").alias("p_partkey"), "taal")


LABELS = {"sthai": ["Sthai:", "Sthayi"], "antara": ["Antara -"]}


def section_labels(spark: SparkSession, sf: str) -> DataFrame:
    p = T.read(spark, sf, "part")
    text = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit(" Sthai "), "p_size")).when(F.col("p_size") % 4 == 1, "Antara :").when(F.col("p_size") % 4 == 2, F.concat(F.lit("Antara of "), "p_name")).otherwise(F.concat(F.lit("Sthayi ੧੨ "), "p_name"))
    at = vocab.section_label_column(text, LABELS)
    return p.select("p_partkey", at.alias("a")).select("p_partkey", F.col("a.kind").alias("kind"), T.shown(F.col("a.n")).alias("n"))


#: Spellings of the swaras in the script of the stand-in tokens.
READS = {"ਸਾ": "S", "ਰੇ": "R", "ਗਾ": "G", "ਮਾ": "M", "ਪਾ": "P", "ਧਾ": "D", "ਨੀ": "N"}


def swara_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every part, dotted, padded, of another script, or no swara at all, and what they say."""
    k = F.col("p_partkey")
    spelled = F.element_at(F.array(*map(F.lit, READS)), (k % 7 + 1).cast("int"))
    token = F.when(k % 4 == 0, F.concat(F.lit(" "), spelled)).when(k % 4 == 1, F.concat(spelled, F.lit("਼ "))).when(k % 4 == 2, F.substring("p_name", 1, 1)).otherwise(F.concat(spelled, F.substring("p_name", 1, 1)))
    return T.read(spark, sf, "part").select("p_partkey", vocab.swara_read(token, F.col("p_size") % 3 > 0, READS).alias("swara"))


def fuzzy_indel(spark: SparkSession, sf: str) -> DataFrame:
    p = T.read(spark, sf, "part").select("p_name", "p_type").distinct()
    return p.select("p_name", "p_type", X.round_ratio(X.indel_ratio(F.col("p_name"), F.lower("p_type"))).alias("ratio"))


# ---- tokenizers


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the documents that is of Latin letters."""
    d = T.read(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), r"[ \t\n\x0B\f\r]+")).alias("word"))
    return d.filter(F.col("word").rlike("^[a-z]+$")).distinct()


def _pieces(spark: SparkSession, sf: str) -> list[str]:
    """A vocabulary from the benchmark's words: their first one to three letters, and pairs of letters that go on with them."""
    b = T.read(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).filter("length(w) > 4").distinct()
    rows = b.select(F.explode(F.array(*[F.substring("w", 1, k) for k in (1, 2, 3)], *[F.concat(F.lit("##"), F.substring("w", at, n)) for at, n in ((3, 2), (4, 2), (4, 1), (5, 1))])).alias("p")).distinct()
    return sorted(r[0] for r in rows.collect())  # some thousands at most: 26 letters, in ones, twos and threes


def _wordpiece(spark: SparkSession, sf: str, length: int = tok.WORDPIECE_LENGTH) -> tok.WordPiece:
    return tok.WordPiece({p: i for i, p in enumerate([tok.PAD, tok.UNK, tok.CLS, tok.SEP, *_pieces(spark, sf)])}, length=length)


def wordpiece_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The longest pieces from the left of every word; one that has a rest is unknown as a whole."""
    w = _wordpiece(spark, sf)
    return _words(spark, sf).select("word", F.array_join(tok.pieces_column(F.col("word"), w), " ").alias("pieces"))


def wordpiece_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's first line as ids between the special ones, cut to sixteen."""
    w = _wordpiece(spark, sf, 16)
    line = F.regexp_replace(F.lower(F.split("text", "\n")[0]), "[^a-z ]", "")
    d = T.read(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", tok.encode_column(line, w).alias("e"))
    return d.select("doc_id", F.size("e.ids").cast("long").alias("n"), F.aggregate("e.mask", F.lit(0).cast("long"), lambda a, m: a + m).alias("mask"), (F.element_at("e.ids", 1) == w.vocab[tok.CLS]).alias("starts"), (F.element_at("e.ids", -1) == w.vocab[tok.SEP]).alias("ends"))


def bert_words(spark: SparkSession, sf: str) -> DataFrame:
    """How many words and signs every line has, and how they read without accents and case."""
    x = T.lines(spark, sf)
    words = tok.words_column(F.col("line"))
    return x.select("line_id", words.alias("w")).select("line_id", F.size("w").cast("long").alias("n"), F.sha2(F.array_join("w", " "), 256).alias("words"))


def unigram_tokens(spark: SparkSession, sf: str) -> DataFrame:
    letters = "abcdefghijklmnopqrstuvwxyz"
    pieces = [("<unk>", 0.0), *((tok.SPACE_MARK + c, -3.0) for c in letters), *((c, -4.0) for c in letters), ("th", -4.5), ("er", -4.5), ("ing", -5.0)]
    u = tok.Unigram(pieces)
    return _words(spark, sf).select("word", F.size(tok.encode_column(F.col("word"), u)["ids"]).cast("long").alias("n"))


def queries() -> dict:
    found = [notation_validate, notation_cells, notation_texts, notation_pages, notation_parsed, notation_hashes, vocab_lookup, raag_names, taal_tempi, taal_names, mark_kinds, taal_markers, taal_of_marks, section_labels, swara_reads, fuzzy_indel, wordpiece_tokens, wordpiece_ids, bert_words, unigram_tokens]
    return {f.__name__: f for f in found}


def _indel(a: str, b: str) -> str:
    """The ratio by rows of the table of longest common subsequences."""
    row = f"list_reduce(list_concat([[0]], list_transform(range(1, length({b}) + 1), lambda j: [j])), lambda acc, j: list_append(acc, CASE WHEN {b}[j[1]] = chr(x[1]::INT) THEN r[j[1]] + 1 ELSE greatest(r[j[1] + 1], acc[j[1]]) END))"
    table = f"list_reduce(list_concat([list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT)], list_transform(range(1, length({a}) + 1), lambda i: [ord({a}[i])::BIGINT])), lambda r, x: {row})"
    return f"(1 - (length({a}) + length({b}) - 2 * list_last({table})) / (length({a}) + length({b}))::DOUBLE)"


def oracle_sql() -> dict[str, str]:
    faults = ", ".join(f"({i}, '{c}', '{p}')" for i, (_, broken) in enumerate(FAULTS) for c, p in broken)
    beats = """SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS m, 'SRGMPDN'[l_partkey % 7 + 1] AS letter, l_quantity::INT % 7 AS what, l_suppkey % 3 - 1 AS oct,
      CASE WHEN l_discount > 0.05 THEN 'b' || l_linenumber END AS g, l_returnflag = 'R' AS r FROM lineitem"""
    octave = "CASE WHEN oct > 0 THEN '''' WHEN oct < 0 THEN ',' ELSE '' END"
    cell = f"CASE what WHEN 0 THEN '-' WHEN 1 THEN '*' ELSE CASE WHEN r AND letter <> 'S' AND letter <> 'P' THEN lower(letter) ELSE letter END || {octave} END"
    names = "translate(letter, 'SRGMPD', 'ਸਰਗਮਪਧ')"
    native = f"CASE what WHEN 0 THEN '—' WHEN 1 THEN '*' ELSE replace({names}, 'N', 'ਨੀ') || CASE WHEN r AND letter IN ('R', 'G', 'D', 'N') THEN chr(818) ELSE '' END || CASE WHEN r AND letter = 'M' THEN chr(769) ELSE '' END || CASE WHEN oct > 0 THEN chr(775) WHEN oct < 0 THEN chr(803) ELSE '' END END"
    line = lambda c: f"string_agg(CASE WHEN m IN (5, 9, 13) THEN '| ' ELSE '' END || ({c}), ' ' ORDER BY m) || ' ||'"
    bols = "string_agg(coalesce(g, ''), ' ' ORDER BY m)"
    page = lambda c: f"'[sthai 1]' || chr(10) || {line(c)} || CASE WHEN count(g) > 0 THEN chr(10) || '  ' || string_agg(coalesce(g, '.'), ' ' ORDER BY m) ELSE '' END"
    q = '"'
    note = f"""'{q}notes{q}:[{{' || CASE WHEN r AND letter IN ('R', 'G', 'D', 'N') THEN '{q}k{q}:true,' ELSE '' END || CASE WHEN oct <> 0 THEN '{q}o{q}:' || oct || ',' ELSE '' END || '{q}s{q}:{q}' || letter || '{q}' || CASE WHEN r AND letter = 'M' THEN ',{q}t{q}:true' ELSE '' END || '}}]'"""
    beat = f"""'{{' || CASE WHEN g IS NULL THEN '' ELSE '{q}bol{q}:{{{q}g{q}:{q}' || g || '{q},{q}h{q}:0}},' END || CASE what WHEN 0 THEN '{q}ext{q}:true,' ELSE '' END || '{q}m{q}:' || m || CASE what WHEN 0 THEN '' WHEN 1 THEN ',{q}rest{q}:true' ELSE ',' || {note} END || '}}'"""
    canonical = f"""'{{{q}raag_used{q}:{q}r' || (l_orderkey % 5) || '{q},{q}sections{q}:[{{{q}kind{q}:{q}sthai{q},{q}lines{q}:[{{{q}beats{q}:[' || string_agg({beat}, ',' ORDER BY m) || '],{q}kind{q}:{q}avartan{q}}}],{q}n{q}:1}}],{q}shabad_id{q}:' || l_orderkey || ',{q}taal{q}:{q}teen{q}}}'"""
    words = "SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) AS w FROM documents) WHERE regexp_matches(w, '^[a-z]+$')"
    vocabulary = """SELECT DISTINCT unnest([w[1:1], w[1:2], w[1:3], '##' || w[3:4], '##' || w[4:5], '##' || w[4:4], '##' || w[5:5]]) AS p FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark) WHERE length(w) > 4"""
    walked = f"""v AS MATERIALIZED (SELECT list(p) AS v FROM ({vocabulary})), known AS MATERIALIZED (SELECT p FROM ({vocabulary})),
      s AS (SELECT word, 1::BIGINT AS at_, ''::VARCHAR AS pieces, 0::BIGINT AS n FROM asked UNION ALL
        SELECT word, at_ + size, pieces || CASE WHEN at_ > 1 THEN ' ##' ELSE '' END || substr(word, at_, size), n + 1 FROM (
          SELECT s.*, CASE WHEN at_ = 1 THEN CASE WHEN k3.p IS NOT NULL THEN 3 WHEN k2.p IS NOT NULL THEN 2 WHEN k1.p IS NOT NULL THEN 1 END ELSE CASE WHEN c2.p IS NOT NULL THEN 2 WHEN c1.p IS NOT NULL THEN 1 END END AS size
          FROM s LEFT JOIN known k3 ON at_ = 1 AND length(word) >= 3 AND k3.p = word[1:3] LEFT JOIN known k2 ON at_ = 1 AND length(word) >= 2 AND k2.p = word[1:2] LEFT JOIN known k1 ON at_ = 1 AND k1.p = word[1:1]
            LEFT JOIN known c2 ON at_ > 1 AND at_ + 1 <= length(word) AND c2.p = '##' || substr(word, at_, 2) LEFT JOIN known c1 ON at_ > 1 AND c1.p = '##' || substr(word, at_, 1)
          WHERE at_ <= length(word)) WHERE size IS NOT NULL),
      done AS (SELECT asked.word, CASE WHEN s.word IS NULL OR length(asked.word) > 100 THEN '[UNK]' ELSE pieces END AS pieces, CASE WHEN s.word IS NULL OR length(asked.word) > 100 THEN 1 ELSE n END AS n FROM asked LEFT JOIN s ON s.word = asked.word AND at_ > length(s.word))"""
    base = "SELECT DISTINCT p_name AS name FROM part"
    marks = "CASE p_size % 2 WHEN 0 THEN 1 ELSE 0 END AS sam, CASE p_size % 3 WHEN 0 THEN 1 ELSE 0 END AS khali"
    signs = "[!-/:-@\\[-`{-~]|\\p{P}"
    return {
        "notation_validate": f"SELECT p_partkey, code, path FROM part JOIN (VALUES {faults}) f(fault, code, path) ON p_partkey % {len(FAULTS)} = fault",
        "notation_cells": f"SELECT l_orderkey::VARCHAR AS id, string_agg({cell}, ' ' ORDER BY m) AS swar, string_agg(CASE m WHEN 1 THEN 'x' WHEN 5 THEN '2' WHEN 9 THEN '0' WHEN 13 THEN '3' ELSE '_' END, ' ' ORDER BY m) AS marks, {bols} AS bol, {line(cell)} AS line FROM ({beats}) GROUP BY l_orderkey",
        "notation_texts": f"SELECT l_orderkey::VARCHAR AS id, {page(cell)} AS text, {page(native)} AS native FROM ({beats}) GROUP BY l_orderkey",
        "notation_pages": f"""SELECT l_orderkey::VARCHAR AS id, '<div class="ntn" data-id="" data-script="english"><div class="ntn-sec" data-kind="sthai" data-n="1"><div class="ntn-sec-label">sthai</div><table class="ntn-line" data-kind="avartan" data-taal="teen" data-from="1"><tr class="ntn-row ntn-row-m">'
          || string_agg('<th class="' || c || '">' || m || '</th>', '' ORDER BY m) || '</tr><tr class="ntn-row ntn-row-swar">' || string_agg('<td class="' || c || '" data-m="' || m || '">' || CASE what WHEN 0 THEN '<span class="n n-ext">-</span>' WHEN 1 THEN '<span class="n n-rest">*</span>'
            ELSE '<span class="n' || CASE WHEN r AND letter IN ('R', 'G', 'D', 'N') THEN ' n-komal' WHEN r AND letter = 'M' THEN ' n-tivra' ELSE '' END || CASE WHEN oct > 0 THEN ' n-taar' WHEN oct < 0 THEN ' n-mandra' ELSE '' END || '" data-s="' || letter || '">' || replace({cell}, chr(39), '&#x27;') || '</span>' END || '</td>', '' ORDER BY m)
          || '</tr>' || CASE WHEN count(g) > 0 THEN '<tr class="ntn-row ntn-row-bol">' || string_agg('<td class="' || c || '">' || coalesce(g, '') || '</td>', '' ORDER BY m) || '</tr>' ELSE '' END || '<tr class="ntn-row ntn-row-mark">' || string_agg('<td class="' || c || '">' || coalesce(k, '') || '</td>', '' ORDER BY m) || '</tr></table></div></div>' AS html
          FROM (SELECT *, CASE m WHEN 1 THEN 'x' WHEN 5 THEN '2' WHEN 9 THEN '0' WHEN 13 THEN '3' END AS k, 'ntn-cell' || CASE WHEN m IN (1, 5, 9, 13) THEN ' ntn-vb' || CASE m WHEN 9 THEN ' ntn-khali' ELSE ' ntn-tali' END ELSE '' END AS c FROM ({beats})) GROUP BY l_orderkey""",
        "notation_parsed": f"SELECT l_orderkey::VARCHAR AS id, m - 1 AS pos, 'avartan' AS kind, CASE WHEN what > 1 THEN letter END AS s, CASE WHEN what > 1 THEN oct ELSE 0 END::BIGINT AS o, what > 1 AND r AND letter IN ('R', 'G', 'D', 'N') AS k, what > 1 AND r AND letter = 'M' AS t, what = 0 AS ext, what = 1 AS rest FROM ({beats})",
        "notation_hashes": f"SELECT l_orderkey AS id, sha1({canonical}) AS hash FROM ({beats}) GROUP BY l_orderkey",
        "vocab_lookup": f"""WITH n AS ({base}), f AS (SELECT DISTINCT p_name AS name, p_name[:-2] || 'q' AS asked FROM part),
          s AS (SELECT f.name, n.name AS other, {_indel('asked', 'n.name')} AS s FROM f, n), b AS (SELECT name, arg_max(other, s) AS best, max(s) AS s, list_sort(list(s), 'DESC')[2] AS second FROM s GROUP BY name)
          SELECT p_partkey, CASE WHEN c < 3 OR c = 4 THEN replace(p_name, ' ', '_') WHEN c = 3 AND ok THEN replace(best, ' ', '_') END AS key, CASE WHEN c < 2 THEN 1 WHEN c = 2 THEN 0.9 WHEN c = 3 AND ok THEN round(s, 3) WHEN c = 4 THEN 0.8 ELSE 0 END::DOUBLE AS confidence,
            CASE WHEN c < 2 THEN 'alias' WHEN c = 2 THEN 'skeleton' WHEN c = 3 AND ok THEN 'fuzzy' WHEN c = 4 THEN 'partial' ELSE 'none' END AS method
          FROM (SELECT *, p_partkey % 6 AS c, s >= 0.85 AND s - second >= 0.05 AS ok FROM part JOIN b ON b.name = p_name)""".replace("p_name[:-2]", "p_name[1:length(p_name) - 1]"),
        "raag_names": "SELECT p_partkey, CASE WHEN v THEN replace(o, ' ', '_') ELSE replace(p_name, ' ', '_') END AS key, CASE WHEN v AND o <> p_name THEN replace(p_name, ' ', '_') END AS parent, 'alias' AS method FROM (SELECT *, p_partkey % 2 = 0 AS v, string_split(p_name, ' ')[1] || ' ring' AS o FROM part)",
        "taal_tempi": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'slow' WHEN 1 THEN 'fast' END AS tempo, p_name || CASE WHEN p_size % 3 = 2 THEN ' drutam' ELSE '' END AS rest FROM part",
        "taal_names": "SELECT p_partkey, replace(p_name, ' ', '_') AS key, CASE p_size % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'slow' END AS tempo, CASE WHEN length(p_name) <> 10 THEN length(p_name) ELSE -1 END AS matras, 'alias' AS method FROM part",
        "mark_kinds": "SELECT p_partkey, CASE WHEN p_size % 8 < 2 THEN 'sam' WHEN p_size % 8 < 4 THEN 'khali' WHEN p_size % 8 < 6 THEN 'tali' END AS kind FROM part",
        "taal_markers": """SELECT p_partkey, k - start AS pos, CASE WHEN (k - 1) % size = 0 AND (k - 1) // size < n - 1 THEN 'x203'[(k - 1) // size + 1] END AS mark FROM (SELECT p_partkey, p_size % 3 + 2 AS size, p_partkey % 3 + 2 AS n, p_size % 2 + 1 AS start, unnest(range(1, 20)) AS k FROM part) WHERE k >= start AND k < start + 5 AND k <= size * n""",
        "taal_of_marks": f"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'teen' WHEN 1 THEN 'jhap' ELSE 'rupak' END AS taal FROM (SELECT *, {marks} FROM part) WHERE (p_partkey % 3 = 0 AND khali = 0) OR (p_partkey % 3 = 1 AND khali = 1) OR (p_partkey % 3 = 2 AND sam = 0 AND khali = 0)",
        "section_labels": "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'sthai' WHEN 1 THEN 'antara' WHEN 3 THEN 'sthai' END AS kind, CASE p_size % 4 WHEN 0 THEN p_size WHEN 3 THEN 12 ELSE -1 END::BIGINT AS n FROM part",
        "swara_reads": "SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN CASE WHEN p_partkey % 4 < 2 THEN 'SRGMPDN'[p_partkey % 7 + 1] END WHEN p_partkey % 4 = 2 AND contains('SRGMPDN', upper(p_name[1])) THEN upper(p_name[1]) END AS swara FROM part",
        "fuzzy_indel": f"SELECT p_name, p_type, floor({_indel('p_name', 'b')} * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS ratio FROM (SELECT DISTINCT p_name, p_type, lower(p_type) AS b FROM part)",
        "wordpiece_tokens": f"WITH RECURSIVE asked AS MATERIALIZED ({words}), {walked} SELECT word, pieces FROM done",
        "wordpiece_ids": f"""WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, list_filter(string_split(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z ]', '', 'g'), ' '), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL),
          asked AS MATERIALIZED (SELECT DISTINCT unnest(ws) AS word FROM l), {walked},
          c AS (SELECT doc_id, least(14, coalesce(sum(n), 0)) + 2 AS n FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [NULL] ELSE ws END) AS word FROM l) LEFT JOIN done USING (word) GROUP BY doc_id) SELECT doc_id, n::BIGINT AS n, n::BIGINT AS mask, true AS starts, true AS ends FROM c""",
        "bert_words": f"""SELECT line_id, len(w) AS n, sha256(array_to_string(w, ' ')) AS words FROM (SELECT line_id, list_filter(regexp_split_to_array(regexp_replace(strip_accents(lower(line)), '({signs})', ' \\1 ', 'g'), '[\\s\\p{{Z}}]+'), lambda x: x <> '') AS w
          FROM (SELECT doc_id * {T.LINES_A_GROUP} + i - 1 AS line_id, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)))""",
        "unigram_tokens": f"""WITH RECURSIVE w AS MATERIALIZED ({words}), d AS (SELECT word, 1::BIGINT AS i, -3::DOUBLE AS b0, 1::BIGINT AS n0, -99999::DOUBLE AS b1, 0::BIGINT AS n1, -99999::DOUBLE AS b2, 0::BIGINT AS n2 FROM w UNION ALL
          SELECT word, i + 1, greatest(one, two, three), CASE WHEN three >= greatest(one, two) THEN n2 + 1 WHEN two >= one THEN n1 + 1 ELSE n0 + 1 END, b0, n0, b1, n1 FROM (
            SELECT *, b0 - 4 AS one, CASE WHEN i >= 2 AND substr(word, i, 2) IN ('th', 'er') THEN b1 - 4.5 ELSE -99999 END::DOUBLE AS two, CASE WHEN i >= 3 AND substr(word, i - 1, 3) = 'ing' THEN b2 - 5 ELSE -99999 END::DOUBLE AS three FROM d WHERE i < length(word)))
          SELECT word, n0 AS n FROM d WHERE i = length(word)""",
    }
