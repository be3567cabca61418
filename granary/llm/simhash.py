"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint of 64 bits is cut into 32 segments of two bits, and each segment becomes its number of set bits (0, 1
or 2). The Manhattan distance of two such points never exceeds the Hamming distance of the fingerprints, so points
farther apart than ``RADIUS`` need no look at the bits. Points are held as packed unary codes (two bits a coordinate:
00, 01, 11): the Manhattan distance is then the bit count of an exclusive or, a built-in expression.

The range join works on a grid of unit cells over each half of the coordinates. At a distance of at most 3, one of the
two halves is at a distance of at most 1, so the two points lie in one cell of that half or in cells that are one step
apart in one coordinate. Each distinct fingerprint is filed in its two cells and asks, per half, for its own cell and
for those one step up: about 28 short rows, whatever the size of the corpus. No candidate of the exact answer is lost,
no bucket is capped, and the join's condition checks the bound and then the bits.

Rows with one fingerprint are one point, so copies never meet each other. Components come from alternating star
contraction on fingerprints; only fingerprints that have a link take part in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import by_place, columns_kept, cut, cut_points, map_slices, read
from granary.llm.graph import least_of_components
from granary.llm.near_copies import near_copies

SHINGLE, SEED, RADIUS = 3, 42, 3
_SPACE = b" \t\n\x0b\x0c\r"
_PIECE = 1 << 20
_ODD, _EVEN = 0x5555555555555555, -0x5555555555555556


def fingerprint(text: bytes) -> bytes:
    """Eight bytes, highest bit first: a bit is set where over half the shingles' XXH64 have it.

    ASCII letters are lower-cased and words parted at ASCII white space. Fewer than three words are one shingle; no
    words at all give zero. Long texts are worked through in pieces that end at white space.
    """
    from xxhash import xxh64_digest

    ones, n, carry, total = np.zeros(64, np.int64), 0, [], 0
    for piece in cut_points(text, _PIECE, _SPACE):
        words = carry + piece.lower().split()
        total = len(words) if not n else SHINGLE
        if len(words) >= SHINGLE:
            digests = [xxh64_digest(b"%b %b %b" % t, SEED) for t in zip(words, words[1:], words[2:])]
            bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
            n += len(digests)
        carry = words[1 - SHINGLE :]
    if not n and total:
        return xxh64_digest(b" ".join(carry), SEED)
    return np.packbits(ones * 2 > n).tobytes()


def _signed(text: bytes) -> int:
    return int.from_bytes(fingerprint(text), "big", signed=True)


def _kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
    col = batch.column(1).cast(pa.binary())
    prints = b"".join(fingerprint(v.as_py() or b"") for v in col)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(prints, ">i8").astype(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; a null text has no words."""
    rows = columns_kept(docs, {"doc_id": id_col, "text": text_col}).withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_slices(rows, "text", _kernel, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """The 32 popcounts of two-bit segments, packed in unary: low bit set if any, high bit if both bits are."""
    odd, even = F.lit(_ODD), F.lit(_EVEN)
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(odd).bitwiseOR(fp.bitwiseAND(F.shiftleft(fp, 1)).bitwiseAND(even))


def links(points: DataFrame) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints at RADIUS or fewer differing bits, each pair once, from distinct ``fp``."""
    at = points.select("fp", embedding(F.col("fp")).alias("e"))
    halves = F.array(F.struct(F.lit(0).alias("h"), F.shiftrightunsigned("e", 32).alias("c")), F.struct(F.lit(1).alias("h"), F.col("e").bitwiseAND(F.lit(0xFFFFFFFF)).alias("c")))
    filed = at.select("fp", F.explode(halves).alias("k")).select(F.col("k.h").alias("h"), F.col("k.c").alias("c"), "fp")
    # One step up in coordinate j: 00 -> 01 and 01 -> 11; the bit pair is shifted left and its low bit set.
    step = "filter(transform(sequence(0, 30, 2), j -> if((c & shiftleft(3L, j)) = shiftleft(3L, j), -1L, c | shiftleft(if((c & shiftleft(1L, j)) = 0L, 1L, 2L), j))), x -> x >= 0)"
    asked = filed.select("h", F.explode(F.concat(F.array("c"), F.expr(step))).alias("c"), F.col("fp").alias("u"), F.col("c").alias("own"))
    filed = filed.withColumnRenamed("fp", "v")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b))
    eu, ev = embedding(F.col("u")), embedding(F.col("v"))
    once = (F.col("own") != F.col("c")) | (F.col("u") > F.col("v"))
    first = (F.col("h") == 0) | (near(F.shiftrightunsigned(eu, 32), F.shiftrightunsigned(ev, 32)) > 1)
    met = asked.join(filed, ["h", "c"])
    return met.filter(once & (near(eu, ev) <= RADIUS) & (near(F.col("u"), F.col("v")) <= RADIUS) & first).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``docs``.

    Empty and null texts share fingerprint zero and are linked to each other. Repeated rows come out as often as they
    go in. A null id stays null and names no component unless it has no other member. An empty table gives no rows. Texts are read
    whole, however long; other columns don't matter, whatever their names.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = least_of_components(points.select("fp", F.col("fp").alias("node"), "least"), "fp", links(points.select("fp")))
    out = prints.join(classes, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, similarity: float | None = None) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id. All columns stay as they are.

    Fingerprints link rows; with a ``similarity``, so does the Jaccard similarity of their shingles of ``shingle`` words, in one
    graph of the rows, whatever their ids. Rows without an id stay, as nothing names them. Of rows that repeat a kept id, one stays. Empty and null texts are copies of
    each other. An empty table stays empty.
    """
    own, at = by_place(docs)
    name = at(id_col)
    if similarity is None:
        found = near_duplicates(docs, id_col, text_col).select("doc_id", "component_id")
    else:
        found = near_copies(docs, id_col, text_col, shingle=shingle, similarity=similarity, also=(_signed, links))
    gone = found.filter(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))).select(F.col("doc_id").alias("__gone"))
    kept = own.join(gone.distinct().hint("shuffle_hash"), F.col(name).cast("long") == F.col("__gone"), "left_anti")
    repeats = found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if repeats:
        kept = kept.filter(F.col(name).isNotNull()).dropDuplicates([name]).unionByName(kept.filter(F.col(name).isNull()))
    return kept.toDF(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
