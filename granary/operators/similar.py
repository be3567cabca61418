"""Pairs of strings that are alike: an exact similarity join by equal keys.

Alike are strings of m and n letters with a common subsequence of L, if 2 L / (m + n) is at least a threshold. They then share as
many letters, counted: of the letters of each, the k-th a and the k-th b, in one order of all such tokens, the rarest first,
the first few must share one, a few more must share two, and so on: up to four, by how many a string may have that its partner
lacks. Each string files a key for each set of so many among its first tokens and for each class of lengths that its partners can
have; only strings that meet in a key, and whose letters allow it, are compared. No pair is lost, and none is met for its length alone.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import indel_ratio

#: Lengths whose ratio is below this are one class. Tokens that are so common that their order matters.
STEP, COMMON = 1.1, 1_000


def tokens(s: Column) -> Column:
    """Each letter with its number among its like: ``abca`` gives a1, b1, c1, a2."""
    letters = F.filter(F.split(s, ""), lambda c: c != "")
    return F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def _class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / log(STEP) + 1e-9).cast("int")


def _least_of(c: Column) -> Column:
    """No length of the class is smaller."""
    return F.greatest(F.floor(F.pow(F.lit(STEP), c) + 1e-6), F.lit(1))


def _sets(head: Column, n: Column) -> Column:
    """All sets of ``n`` (1 to 4) of an array's strings, each as one string."""
    level = F.transform(head, lambda t, i: F.struct(i.alias("i"), t.alias("s")))
    told = lambda x: F.transform(x, lambda e: e["s"])
    out = F.when(n <= 1, told(level))
    for k in range(2, 5):
        level = F.flatten(F.transform(level, lambda e: F.transform(F.slice(head, e["i"] + 2, F.size(head)), lambda b, j: F.struct((e["i"] + 1 + j).alias("i"), F.concat(e["s"], F.lit("|"), b).alias("s")))))
        out = out.when(n == k, told(level))
    return out


def _filed(strings: DataFrame, name: str, order: Column, least: float, first: bool) -> DataFrame:
    """(name, key) of each string; the class of lengths on the left comes first in a key."""
    n = F.length(name)
    ranked = F.array_sort(F.transform(tokens(F.col(name)), lambda t: F.struct(F.coalesce(F.try_element_at(order, t), F.lit(0)).alias("rank"), t.alias("t"))))
    own = strings.select(name, n.alias("n"), _class(n).alias("c"), F.transform(ranked, lambda r: r["t"]).alias("ts"))
    lo, hi = F.greatest(F.ceil(F.col("n") * (least / (2 - least)) - 1e-6), F.lit(1)), F.floor(F.col("n") * ((2 - least) / least) + 1e-6)
    met = own.withColumn("other", F.explode(F.sequence(_class(lo), _class(hi))))
    shared = F.greatest(F.ceil((_least_of(F.col("c")) + _least_of(F.col("other"))) * (least / 2) - 1e-6), F.lit(1)).cast("int")
    spare = F.greatest(_least_of(F.col("c")), _least_of(F.col("other"))) - shared  # the same on both sides
    several = F.least(F.when(spare <= 5, 4).when(spare <= 8, 3).otherwise(2), shared)
    head = F.slice("ts", F.lit(1), F.greatest(F.col("n") - shared + several, F.lit(0)))
    kept = met.withColumns({"several": several, "head": head})
    key = F.explode(_sets(F.col("head"), F.col("several")))
    a, b = ("c", "other") if first else ("other", "c")
    return kept.select(name, F.col(a).alias("__a"), F.col(b).alias("__b"), key.alias("__key"))


def candidates(left: DataFrame, a: str, right: DataFrame, b: str, least: float) -> DataFrame:
    """(a, b): distinct pairs of strings that can be alike by ``least`` or more, all that are among them. Nulls and empty strings
    are like nothing. ``right`` settles the order of tokens, of which at most ``COMMON`` are told to the driver."""
    if not 0 < least <= 1:
        raise ValueError("least is over 0 and at most 1")
    left, right = (d.select(c).filter(F.length(c) > 0).distinct() for d, c in ((left, a), (right, b)))
    counts = right.select(F.explode(tokens(F.col(b))).alias("t")).groupBy("t").count().orderBy(F.desc("count"), "t").limit(COMMON).collect()
    # common tokens come last, in order of their number; all others are rare and come first, by themselves
    order = F.create_map(*[F.lit(x) for i, r in enumerate(reversed(counts), 1) for x in (r["t"], i)]) if counts else F.lit(None).cast("map<string,int>")
    x, y = _filed(left, a, order, least, True), _filed(right, b, order, least, False)
    met = x.join(y, ["__a", "__b", "__key"]).select(a, b).distinct()
    shared = F.size(F.array_intersect(tokens(F.col(a)), tokens(F.col(b))))
    return met.filter(2 * shared >= least * (F.length(a) + F.length(b)) - 1e-6)


def alike(left: DataFrame, a: str, right: DataFrame, b: str, least: float, score: str = "ratio") -> DataFrame:
    """(a, b, score) of all pairs of distinct strings that are alike by ``least`` or more."""
    scored = candidates(left, a, right, b, least).withColumn(score, indel_ratio(F.col(a), F.col(b)))
    return scored.filter(F.col(score) >= least)
