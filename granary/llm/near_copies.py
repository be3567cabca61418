"""Near copies by the Jaccard similarity of word shingles, none lost: a prefix join, then the exact similarity.

A text is the set of its shingles' hashes of 64 bits. Sets are put in one order for all texts, in which shingles that a sample finds
common come last. Two sets at a similarity of ``t`` or more share a shingle among the first ``n - ceil(t n) + 1`` of each,
so texts meet in the buckets of those few; the sizes and the places of the shingle rule most other pairs out. The sample
settles how full buckets are, not what is found.

Equal sets are one point. Every point of a bucket is first compared with a few heads of the bucket only: per class of
sizes the point with the fewest shingles before the bucket's own, which is the text that the others are copies of; then
those pairs that are not yet connected are compared, so a large group of near copies doesn't meet itself pair by pair.
Buckets of shingles that the sample finds common, COMMON at most, are not brought together: their heads are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import columns_kept, cut, cut_points, map_slices, sized, stored
from granary.llm.graph import beside, components, least_of_components

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
SAMPLE, COMMON = 4_000, 50_000
#: Of each set, how many elements fall in which bin, FULL or more as FULL: a bound on what two sets share. Sets of over
#: LONG elements have more bins.
BINS, LONG_BINS, LONG, FULL = 128, 1024, 2_000, 127
#: Ids of texts to be read again that may be broadcast; more are joined by a shuffle.
MOST_SENT = 2_000_000
#: First elements of a set that a row carries where pairs are made.
SEEN = 4
_SPACE, _PIECE, _TINY = b" \t\n\x0b\x0c\r", 1 << 20, 1e-9


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def _joined(words: np.ndarray, k: int) -> np.ndarray:
    """A number for ``k`` words in a row, from each place on."""
    m = len(words) - k + 1
    out = _mixed(words[:m])
    for j in range(1, k):
        out = _mixed(out + words[j : j + m])
    return out


def shingles(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """The distinct numbers of ``k`` words in a row, mixed from the words' XXH64, sorted. Words are those of the
    fingerprints; fewer than ``k`` are one shingle, and no words at all none. Long texts go in pieces that end at white
    space."""
    from xxhash import xxh64_digest

    found: list[np.ndarray] = []
    words = np.zeros(0, np.uint64)
    for piece in cut_points(text, _PIECE, _SPACE):
        more = b"".join([xxh64_digest(w, SEED) for w in piece.lower().split()])
        words = np.concatenate((words, np.frombuffer(more, ">u8").astype(np.uint64)))
        if len(words) >= k:
            found.append(_joined(words, k))
            words = words[len(words) - k + 1 :]
    if not found and len(words):
        found.append(_joined(words, len(words)))
    return np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0, np.int64)])))


def _name(found: np.ndarray) -> int:
    from xxhash import xxh64_digest

    return int.from_bytes(xxh64_digest(found.tobytes(), SEED), "big", signed=True) if len(found) else 0


def _sets(k: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(v.as_py() or b"", k) for v in batch.column(1).cast(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(map(_name, found), pa.int64()), _lists(found)], ["s", "all"])

    return run


def _prefixes(k: int, t: float, common: np.ndarray, mark: Callable[[bytes], int] | None) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, sizes, rare, first, bins, marks = [], [], [], [], [], []
        for v in batch.column(1).cast(pa.binary()):
            text = v.as_py() or b""
            found = shingles(text, k)
            marks.append(mark(text) if mark else 0)
            n, late = len(found), np.zeros(len(found), bool)
            if len(common):
                late = common[np.searchsorted(common, found).clip(max=len(common) - 1)] == found
            names.append(_name(found))
            sizes.append(n)
            first.append(np.concatenate((found[~late], found[late]))[: n - int(np.ceil(t * n - _TINY)) + 1])
            rare.append(int((~late).sum()))
            many = LONG_BINS if n > LONG else BINS
            bins.append(np.bincount(found & (many - 1), minlength=many).clip(max=FULL).astype(np.int8))
        ends = pa.array(np.cumsum([0, *map(len, bins)]).astype(np.int32))
        counts = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*bins, np.zeros(0, np.int8)])))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(rare, pa.int32()), _lists(first), counts, pa.array(marks, pa.int64())], ["doc_id", "s", "n", "rare", "first", "bins", "fp"])

    return run


def _counts(k: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(v.as_py() or b"", k) for v in batch.column(1).cast(pa.binary())]
        w, c = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w), pa.array(c.astype(np.int64))], ["w", "c"])

    return run


def _common(rows: DataFrame, k: int) -> np.ndarray:
    """At most COMMON shingles that three or more of about SAMPLE texts have."""
    step = max(1, rows.count() // SAMPLE)
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0)
    counted = map_slices(drawn, "text", _counts(k), "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    return np.sort(np.array([r[0] for r in counted.filter("c >= 3").orderBy(F.desc("c"), "w").limit(COMMON).select("w").collect()], np.int64))


def _may(n: Column, i: Column, m: Column, j: Column, t: float) -> Column:
    """Whether sets of sizes n and m whose first common element is at places i and j can be at ``t`` or more."""
    return F.least(n - i, m - j) * (1 + t) + _TINY >= (n + m) * F.lit(t)


def _sent(ids: DataFrame, n: int) -> DataFrame:
    return F.broadcast(ids) if n <= MOST_SENT else ids


def _alike(pairs: DataFrame, rows: DataFrame, points: DataFrame, bins: DataFrame, k: int, t: float) -> DataFrame:
    """Of the pairs (u, v) those at ``t`` or more: first by the bins, then from the texts read again."""
    n = pairs.count()
    pairs = sized(pairs, n)
    named = pairs.select(F.explode(F.array("u", "v")).alias("r")).distinct()
    bins = bins.join(_sent(named, 2 * n), "r", "left_semi")
    both = pairs.join(bins.toDF("u", "n", "x"), "u").join(bins.toDF("v", "m", "y"), "v")
    bound = F.aggregate(F.zip_with("x", "y", lambda x, y: F.least(x, y)), F.lit(0), lambda z, x: z + F.when(x == FULL, 1 << 24).otherwise(x.cast("int")))
    pairs = cut(both.filter((F.size("x") != F.size("y")) | (bound * (1 + t) + _TINY >= (F.col("n") + F.col("m")) * F.lit(t))).select("u", "v"))
    n = pairs.count()
    pairs = sized(pairs, n)
    named = pairs.select(F.explode(F.array("u", "v")).alias("r")).distinct()
    ends = cut(points.join(_sent(named, 2 * n), "r"))
    n = ends.count()
    ends = sized(ends, n)
    ids = _sent(ends.select(F.col("least").alias("__id")).distinct(), n)
    texts = rows.join(ids, rows.doc_id.eqNullSafe(F.col("__id")), "left_semi")
    sets = cut(map_slices(texts, "text", _sets(k), "s long, all array<long>").join(ends.select("s", "r"), "s").dropDuplicates(["r"]).select("r", "all"))
    both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return cut(both.filter(shared * (1 + t) + _TINY >= (F.size("a") + F.size("b")) * F.lit(t)).select("u", "v"))


def _size(n: Column, t: float) -> Column:
    """A class of sizes. Sets at a similarity of ``t`` or more are of one class or of neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / -float(np.log(t))).cast("int")


def _heads(filed: DataFrame, t: float) -> DataFrame:
    """Per bucket its number of rows ``c`` and, for each class of sizes, the point with the fewest shingles before the
    bucket's: a text that others are copies of, if there is one, as their edits come first."""
    place = F.shiftleft(F.col("i").cast("long"), 32) + F.col("n")
    best = filed.withColumn("z", _size(F.col("n"), t)).withColumn("p", place).groupBy("w", "z").agg(F.min("p").alias("p"), F.min_by("r", "p").alias("r"), F.count("*").alias("c"))
    head = F.struct("r", F.col("p").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("n"), F.shiftright("p", 32).cast("int").alias("i"))
    return best.groupBy("w").agg(F.sum("c").alias("c"), F.map_from_entries(F.collect_list(F.struct(F.col("z"), head))).alias("by_size"))


def _near(t: float) -> Column:
    """The bucket's heads of a row's class and its neighbours, three at most."""
    return F.array_compact(F.array(*[F.try_element_at("by_size", _size(F.col("n"), t) + d) for d in (-1, 0, 1)]))


def _ordered(a: Column, b: Column) -> tuple[Column, Column]:
    return F.greatest(a, b).alias("u"), F.least(a, b).alias("v")


def _marked(found: DataFrame, points: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (u, v) of points with rows of one ``fp``, or of two that ``links`` links. A number with a large share of the points doesn't
    meet in one task."""
    pairs = stored(found.select("s", "fp").distinct().join(points.select("s", "r"), "s").select(F.col("fp").alias("u"), F.col("r").alias("v")).distinct())
    named = stored(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    stars = beside(pairs, named.filter("n > 1"), pairs.count()).select(F.col("v").alias("u"), F.col("m").alias("v"))
    heads = named.select("u", "m")
    linked = stored(links(named.select(F.col("u").alias("fp")))).join(heads.toDF("u", "a"), "u").join(heads.toDF("v", "b"), "v")
    return stored(stars).unionByName(stored(linked.select(F.col("a").alias("u"), F.col("b").alias("v"))))


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, similarity: float = SIMILARITY,
    also: tuple[Callable[[bytes], int], Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """(doc_id, component_id), a row for each row of ``docs``: the least id that links of ``similarity`` or more lead to.

    Empty and null texts are copies of each other. A null id names no component unless it has no other member.
    ``also`` adds links: a number for each text, and what gives linked pairs (u, v) of distinct numbers ``fp``; rows of one number
    are linked. They are in one graph with the others, so what they connect isn't compared again.
    """
    k, t = shingle, similarity
    rows = columns_kept(docs, {"doc_id": id_col, "text": text_col}).withColumn("doc_id", F.col("doc_id").cast("long"))
    # r names a row; the checkpoint keeps it. Of equal sets, the row of the least r is the point.
    found = cut(map_slices(rows, "text", _prefixes(k, t, _common(rows, k), also[0] if also else None), "doc_id long, s long, n int, rare int, first array<long>, bins array<tinyint>, fp long").withColumn("r", F.monotonically_increasing_id()))
    points = cut(found.groupBy("s").agg(F.min("doc_id").alias("least"), F.min("r").alias("r")))
    more = cut(found.select("s", F.col("r").alias("own")).join(points, "s").filter("own <> r").select(F.col("own").alias("r")))
    own = found.join(_sent(more, more.count()), "r", "left_anti")
    filed = own.filter("n > 0").select("r", "n", "rare", F.posexplode("first").alias("i", "w"))
    cols = ["w", "r", "n", "i"]
    often, seldom = filed.filter("i >= rare").select(cols), filed.filter("i < rare").select(cols).repartition("w")
    met = seldom.join(_heads(seldom, t).hint("shuffle_hash"), "w").unionByName(often.join(F.broadcast(_heads(often, t)), "w"))  # COMMON heads at most
    met = cut(met.filter("c > 1").select(*cols, _near(t).alias("heads")))
    bins = found.select("r", "n", "bins")
    near = met.select("r", "n", "i", F.explode("heads").alias("h")).filter((F.col("r") != F.col("h.r")) & _may(F.col("n"), F.col("i"), F.col("h.n"), F.col("h.i"), t))
    one = cut(near.select(*_ordered(F.col("r"), F.col("h.r"))).distinct())
    edges = _alike(one, rows, points, bins, k, t)
    if also:
        edges = stored(edges).unionByName(_marked(found, points, also[1]))
    roots = components(edges).withColumnRenamed("node", "r")
    # Two sets are compared where the first of their common elements is; the first elements of each tell most other places.
    seen = [f"k{x}" for x in range(SEEN)]
    firsts = found.select("r", *[F.get("first", x).alias(k) for x, k in enumerate(seen)])
    at = cut(met.select("w", "r", "n", "i").join(roots, "r", "left").withColumn("root", F.coalesce("root", "r")))
    mixed = at.groupBy("w").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("w")
    at = at.join(mixed, "w", "left_semi").join(firsts, "r").select("w", "r", "n", "i", "root", *seen)
    other = at.toDF("w", "r2", "n2", "i2", "root2", *[f"{k}_2" for k in seen])
    earlier = reduce(lambda a, b: a | b, [F.coalesce((F.col(f"k{x}") == F.col(f"k{y}_2")) & (F.col("i") > x) & (F.col("i2") > y), F.lit(False)) for x in range(SEEN) for y in range(SEEN)])
    apart = at.join(other, "w").filter((F.col("root") < F.col("root2")) & _may(F.col("n"), F.col("i"), F.col("n2"), F.col("i2"), t) & ~earlier)
    two = cut(apart.select(*_ordered(F.col("r"), F.col("r2"))).distinct().join(one, ["u", "v"], "left_anti"))
    edges = roots.filter("r <> root").select(F.col("r").alias("u"), F.col("root").alias("v")).unionByName(_alike(two, rows, points, bins, k, t))
    named = least_of_components(points.select("s", F.col("r").alias("node"), "least"), "s", edges)
    return found.select("doc_id", "s").join(named, "s").select("doc_id", "component_id")
