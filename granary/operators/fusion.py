"""Reciprocal-rank fusion as two aggregations.

Lists are rows (list_id, index, via, weight, rank, key, id, score) with ranks from 1. A list gives a key one vote, at the
key's best rank; rows without a key keep their rank and vote for nothing. A key's score is the sum of
weight / (60 + rank), rounded to six places before keys are put in order: score from high to low, then key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.numeric import RRF_OFFSET, clamp_k, round6


def as_list(hits: DataFrame, list_id: str, index: str, via: str, key: Column, weight: float | None = None) -> DataFrame:
    """A ranked list from hits (id, row, score) of a top-k."""
    rank = F.row_number().over(Window.partitionBy("list_id").orderBy(F.desc("score"), F.asc("row")))
    keyed = hits.select(F.lit(list_id).alias("list_id"), F.lit(index).alias("index"), F.lit(via).alias("via"), F.lit(weight).cast("double").alias("weight"), key.alias("key"), "id", "row", "score")
    return keyed.withColumn("rank", rank).drop("row")


def union_lists(lists: Sequence[DataFrame]) -> DataFrame:
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out


def fuse_by(lists: DataFrame, k: float, order: Sequence[str] = ("key",)) -> DataFrame:
    """(key, score, votes, hits): ``hits`` has a struct (index, via, rank, id, score) for each list that voted.

    Lists of a weight of zero or less are silent; a weight that is missing or not finite is 1. ``order`` may name
    several columns that make up the key and settle ties.
    """
    w = F.col("weight")
    weight = F.when(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")), 1.0).otherwise(w)
    own = lists.withColumn("weight", weight).filter("weight > 0")
    for c in order:
        own = own.filter(F.col(c).isNotNull())
    best = own.groupBy("list_id", *order).agg(F.min_by(F.struct("index", "via", "rank", "id", "score", "weight"), "rank").alias("h"))
    hits = best.groupBy(*order).agg(F.array_sort(F.collect_list(F.struct("list_id", "h"))).alias("hs"))
    score = F.aggregate("hs", F.lit(0.0), lambda s, x: s + x["h"]["weight"] / (RRF_OFFSET + x["h"]["rank"]))
    shown = F.transform("hs", lambda x: F.struct(*[x["h"][c].alias(c) for c in ("index", "via", "rank", "id", "score")]))
    out = hits.select(*order, round6(score).alias("score"), F.size("hs").cast("long").alias("votes"), shown.alias("hits"))
    return out.orderBy(F.desc("score"), *order).limit(clamp_k(k, 2**31 - 1))
