"""Names to keys of a vocabulary, by a ladder of joins: alias, skeleton, alike spelling, part of the name.

Entries are (key, spelling). Their folds, skeletons and collisions are derived tables; texts climb the ladder by joins
with them, and the first step that answers wins. Vocabularies have some hundreds of entries and are small beside the texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from granary.operators.similar import alike

# Thresholds of the ladder, and the letters that skeletons don't tell apart.
FUZZY_RAAG, FUZZY_TAAL, MARGIN, FUZZY_LETTERS, SKELETON_LETTERS = 0.85, 0.80, 0.05, 4, 3
ALIAS, SKELETON, PARTIAL = 1.0, 0.9, 0.8
SAME_NATIVE = {"ਟ": "ਤ", "ਠ": "ਥ", "ਡ": "ਦ", "ਢ": "ਧ", "ੜ": "ਦ", "ਣ": "ਨ", "ਵ": "ਬ", "ਯ": "ਜ"}
SAME_LATIN = {"w": "v", "z": "j"}
NATIVE_LETTERS = "ਅ-ਊਏਐਓ-ਨਪ-ਰਲ-ਲ਼ਵਸ਼ਸਹਖ਼-ੜਫ਼ੲ-ੴ"
NATIVE_SIGNS = "ਾ-ੂੇੈੋੌ"


def fold_native(text: str | None, stops: Sequence[str] = ()) -> str:
    """Letters and vowel signs only; marks that spellings differ in, final short vowels and stop words go."""
    s = unicodedata.normalize("NFC", text or "")
    s = re.sub("[​‌‍­﻿਼ੱ੍]", "", s).replace("ਂ", "ੰ")
    s = re.sub(f"[^{NATIVE_LETTERS}{NATIVE_SIGNS}ੰ ]", " ", s)
    drop = {re.sub("[ੁਿ]$", "", re.sub("[਼ੱ੍]", "", w).replace("ਂ", "ੰ")) for w in stops}
    return " ".join(w for w in (re.sub("[ੁਿ]$", "", x) for x in s.split()) if w and w not in drop)


def fold_latin(text: str | None, stops: Sequence[str] = ()) -> str:
    s = "".join(c for c in unicodedata.normalize("NFKD", text or "") if unicodedata.category(c)[0] != "M").lower()
    return " ".join(w for w in re.sub("[^a-z]+", " ", s).split() if w not in set(stops))


def _fold(native: bool, stops: Sequence[str]):  # noqa: ANN202
    def run(col: pa.Array) -> pa.Array:
        one = fold_native if native else fold_latin
        return pa.array([one(v, stops) for v in col.to_pylist()], pa.string())

    return F.arrow_udf(run, StringType(), F.ArrowUDFType.SCALAR)


def skeleton(folded: Column, native: bool) -> Column:
    """Without vowels and doubled letters, alike consonants as one."""
    same, vowels = (SAME_NATIVE, f"[{NATIVE_SIGNS}ੰਅ-ਊਏਐਓਔੲ-ੴ]") if native else (SAME_LATIN, "[aeiou]")
    bare = F.replace(folded, F.lit(" "), F.lit(""))
    if native:
        return F.regexp_replace(F.translate(F.regexp_replace(bare, vowels, ""), "".join(same), "".join(same.values())), r"(.)\1+", "$1")
    return F.regexp_replace(F.regexp_replace(F.translate(bare, "".join(same), "".join(same.values())), vowels, ""), r"(.)\1+", "$1")


@dataclass
class Vocabulary:
    """Derived tables of (ord, key, spelling) entries: ``ord`` settles which of two equal aliases counts."""

    entries: DataFrame
    native: bool = False
    stops: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        fold = _fold(self.native, self.stops)
        self.names = self.entries.select("ord", "key", fold(F.col("spelling")).alias("fold")).filter("fold <> ''")
        self.alias = self.names.groupBy("fold").agg(F.min_by("key", "ord").alias("alias_key"))
        self.joined = self.names.groupBy(F.replace("fold", F.lit(" "), F.lit("")).alias("bare")).agg(F.min_by("key", "ord").alias("bare_key"))
        keys = self.names.withColumn("skel", skeleton(F.col("fold"), self.native)).groupBy("skel").agg(F.collect_set("key").alias("keys"))
        self.skeletons = keys.filter((F.size("keys") == 1) & (F.length("skel") >= SKELETON_LETTERS)).select("skel", F.col("keys")[0].alias("skel_key"))
        self.collisions = keys.filter(F.size("keys") > 1).select("skel", F.array_sort("keys").alias("keys"))

    def fuzzy(self, folds: DataFrame, accept: float) -> DataFrame:
        """(fold, fuzzy_key, fuzzy_score): the most alike name, if no other key comes within the margin. Texts and names meet by the
        keys of :mod:`granary.operators.similar`, so only those that can be alike are compared."""
        names = self.names.select(F.col("fold").alias("name"), "key").distinct()
        asked = folds.filter(F.length("fold") >= FUZZY_LETTERS).select("fold").distinct()
        scored = alike(asked, "fold", names, "name", accept - MARGIN, "s").join(names, "name").groupBy("fold", "key").agg(F.max("s").alias("s"))
        w = Window.partitionBy("fold").orderBy(F.desc("s"), F.desc("key"))
        best = scored.withColumn("n", F.row_number().over(w)).withColumn("second", F.lead("s").over(w)).filter("n = 1")
        ok = (F.col("s") >= accept) & (F.coalesce(F.col("s") - F.col("second") >= MARGIN, F.lit(True)))
        return best.filter(ok).select("fold", F.col("key").alias("fuzzy_key"), F.round("s", 3).alias("fuzzy_score"))

    def partial(self, folds: DataFrame) -> DataFrame:
        """(fold, part_key): a run of its words that is an alias, the longest first, then the leftmost."""
        words = folds.select("fold").distinct().withColumn("w", F.split("fold", " "))
        runs = words.select("fold", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("n")).select("fold", "w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("i"))
        parts = runs.select("fold", "n", "i", F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("part"))
        hit = parts.join(self.alias.withColumnRenamed("fold", "part"), "part")
        return hit.groupBy("fold").agg(F.min_by("alias_key", F.struct(-F.col("n"), "i")).alias("part_key"))

    def lookup(self, texts: DataFrame, text: str = "text", accept: float | None = None) -> DataFrame:
        """``texts`` with key, confidence and method; the last two steps are for texts of the script, where ``accept``
        is given."""
        t = texts.withColumn("fold", _fold(self.native, self.stops)(F.col(text)))
        t = t.withColumn("bare", F.replace("fold", F.lit(" "), F.lit(""))).withColumn("skel", skeleton(F.col("fold"), self.native))
        t = t.join(self.alias, "fold", "left").join(self.joined, "bare", "left").join(self.skeletons, "skel", "left")
        exact = F.coalesce("alias_key", "bare_key")
        if accept is None:
            t = t.withColumn("fuzzy_key", F.lit(None).cast("string")).withColumn("fuzzy_score", F.lit(None).cast("double")).withColumn("part_key", F.lit(None).cast("string"))
        else:
            open_ = t.filter(exact.isNull() & F.col("skel_key").isNull() & (F.col("fold") != ""))
            t = t.join(self.fuzzy(open_, accept), "fold", "left").join(self.partial(open_), "fold", "left")
        step = F.when(exact.isNotNull(), F.struct(exact.alias("key"), F.lit(ALIAS).alias("confidence"), F.lit("alias").alias("method")))
        for key, confidence, method in (("skel_key", F.lit(SKELETON), "skeleton"), ("fuzzy_key", F.col("fuzzy_score"), "fuzzy"), ("part_key", F.lit(PARTIAL), "partial")):
            step = step.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("key"), confidence.alias("confidence"), F.lit(method).alias("method")))
        step = step.otherwise(F.struct(F.lit(None).cast("string").alias("key"), F.lit(0.0).alias("confidence"), F.lit("none").alias("method")))
        return t.withColumn("found", step).select(*texts.columns, "found.*")


def normalise_raag(vocabulary: Vocabulary, texts: DataFrame, parents: DataFrame, accept: float | None = None) -> DataFrame:
    """(ord, text, key, parent, confidence, method): bracketed variants first, then the name outside; the key's own
    parent (key, parent), else the name outside if it is another key."""
    inner = F.regexp_extract_all("text", F.lit(r"\(([^()]+)\)"), F.lit(1))
    outer = F.regexp_replace("text", r"\([^()]*\)", " ")
    tried = texts.select("ord", "text", F.posexplode(F.concat(inner, F.array(outer), F.array("text"))).alias("i", "part"), F.size(inner).alias("n"))
    hits = vocabulary.lookup(tried, "part", accept)
    first = hits.groupBy("ord", "text", "n").agg(F.min_by(F.struct("key", "confidence", "method"), F.when(F.col("key").isNotNull(), F.col("i")).otherwise(1000 + F.col("i"))).alias("h"), F.max(F.when((F.col("i") == F.col("n")) & F.col("method").isin("alias", "skeleton"), F.col("key"))).alias("base"))
    own = first.select("ord", "text", "n", "h.*", "base").join(parents, "key", "left")
    parent = F.coalesce("parent", F.when((F.col("n") > 0) & (F.col("base") != F.col("key")), F.col("base")))
    return own.select("ord", "text", "key", parent.alias("parent"), "confidence", "method")


def split_tempo(text: Column, tempi: dict[str, Sequence[str]]) -> tuple[Column, Column]:
    """The last tempo whose words occur, and the text without any; longer words first."""
    found, rest = F.lit(None).cast("string"), text
    edge = "A-Za-z\\x{0A00}-\\x{0A7F}"
    for key, words in tempi.items():
        for word in sorted(words, key=len, reverse=True):
            pattern = f"(?i)(?<![{edge}])\\(?\\s*{re.escape(word)}\\s*\\)?(?![{edge}])"
            found = F.when(rest.rlike(pattern), key).otherwise(found)
            rest = F.regexp_replace(rest, pattern, " ")
    return found, rest


def normalise_taal(vocabulary: Vocabulary, texts: DataFrame, matras: DataFrame, tempi: dict[str, Sequence[str]], accept: float | None = None) -> DataFrame:
    """(ord, text, key, tempo, matras, confidence, method): the name that is left once the tempo's words are gone, looked up;
    ``matras`` (key, matras) says how many beats a taal has."""
    tempo, rest = split_tempo(F.coalesce("text", F.lit("")), tempi)
    found = vocabulary.lookup(texts.select("ord", "text", tempo.alias("tempo"), rest.alias("rest")), "rest", accept)
    return found.join(matras, "key", "left").select("ord", "text", "key", "tempo", "matras", "confidence", "method")


def mark_kind(glyph: Column, symbols: dict[str, Sequence[str]]) -> Column:
    """The first kind (sam, khali, tali) whose signs hold a printed one; null for others."""
    return F.coalesce(*[F.when(F.trim(glyph).isin(*signs), kind) for kind, signs in symbols.items()])


def beat_marks(vibhag: Column, marks: Column, start: Column, count: Column | None = None) -> Column:
    """The mark over each beat of a cycle, null between; cut to ``count`` beats from beat ``start`` on."""
    each = F.transform(F.sequence(F.lit(1), F.size(vibhag)), lambda i: F.concat(F.array(F.try_element_at(marks, i)), F.array_repeat(F.lit(None).cast("string"), F.element_at(vibhag, i) - 1)))
    whole = F.flatten(each)
    at = F.greatest(F.lit(1), start)
    return F.slice(whole, at, F.size(whole) if count is None else count)


def taal_of_marks(taals: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, taal): the one taal of ``matras`` beats whose sam, khali and tali are where the row's marks (beat -> kind)
    say; none if several are."""
    fits = F.forall(F.map_entries("marks"), lambda e: F.when(e["value"] == "sam", e["key"] == F.col("sam")).when(e["value"] == "khali", F.array_contains("khali", e["key"])).when(e["value"] == "tali", F.array_contains("tali", e["key"])).otherwise(True))
    met = rows.join(taals.filter("vibhag IS NOT NULL"), rows.beats == taals.matras).filter(fits)
    return met.groupBy("id").agg(F.when(F.count("*") == 1, F.first("key")).alias("taal")).filter("taal IS NOT NULL")


#: Fixed value: the order of the seven swaras.
SWARAS = "SRGMPDN"


def swara_read(token: Column, native: Column, reads: dict[str, str]) -> Column:
    """The swara of one printed token, null for what is none. ``reads`` has the spellings of the script, whose dots don't count; where ``native``
    is false a single letter of the seven is read, in either case."""
    t = F.trim(F.coalesce(token, F.lit("")))
    known = F.create_map(*[F.lit(x) for kv in reads.items() for x in kv]) if reads else F.lit(None).cast("map<string,string>")
    letter = F.when(F.upper(t).rlike(f"^[{SWARAS}]$"), F.upper(t))
    return F.when(F.coalesce(native, F.lit(False)), F.try_element_at(known, F.replace(t, F.lit("਼"), F.lit("")))).otherwise(letter)


def section_label_column(text: Column, labels: dict[str, Sequence[str]]) -> Column:
    """struct(kind, n) of :func:`section_label`, or null."""
    arrow = pa.struct([("kind", pa.string()), ("n", pa.int32())])
    made = lambda v: None if v is None else {"kind": v[0], "n": v[1]}
    return F.arrow_udf(lambda col: pa.array([made(section_label(t, labels)) for t in col.to_pylist()], arrow), "struct<kind: string, n: int>", F.ArrowUDFType.SCALAR)(text)


def section_label(text: str | None, labels: dict[str, Sequence[str]]) -> tuple[str, int | None] | None:
    """Kind and number of a printed label that starts with a known one and goes on with little but a number."""
    s = (text or "").strip()
    for kind, known in labels.items():
        for label in (x.rstrip(": -") for x in known):
            if s.startswith(label):
                tail = s[len(label) :]
                number = re.search("[0-9੦-੯]+", tail)
                if not number and len(tail.strip(" :-.()")) > 6:
                    return None
                return kind, int(number[0]) if number else None
    return None
