"""Exhaustive search over quantised vectors: exact, with rounded scores and one order for ties.

An index is a DataFrame with row (long), id (long), codes (array<tinyint>), scale (float) and mask (boolean); other
columns may follow. Scores are round6(sum(query * code) * scale); they go from high to low, ties by row. Nothing is
approximated: :func:`search` is a projection and a top-k that Spark plans as TakeOrderedAndProject, and
:func:`search_arrow` is the same over Arrow batches of which each gives its k best at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.numeric import RRF_OFFSET, clamp_k, dequantize, dot, project, quantize, round6, scale_of, vector
from granary.sources.store import folder

#: Queries that go to all rows at once; more go in several rounds.
SENT_BYTES = 64 << 20
BATCH_QUERIES = 2_000
#: Rows that a tile of queries meets at once: with BATCH_QUERIES a tile of scores has 16 MB.
TILE_ROWS = 1_024


def build_index(vectors: DataFrame, id_col: str, vector_col: str, mask: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Quantise vectors. Rows are numbered by their ids, which must be unique; that needs no global order of them."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), (F.lit(True) if mask is None else mask).alias("mask"), *keep)
    s = v.withColumn("scale", scale_of(F.col("v")))
    return s.select(F.col("id").alias("row"), "id", quantize(F.col("v"), F.col("scale")).alias("codes"), F.col("scale").cast("float").alias("scale"), "mask", *keep)


def _checked(query: Sequence[float], dim: int | None = None) -> list[float]:
    q = [float(np.float32(x)) for x in query]
    if not all(map(math.isfinite, q)):
        raise ValueError("the query isn't finite")
    if dim is not None and len(q) != dim:
        raise ValueError(f"the query has {len(q)} dimensions, the index {dim}")
    return q


def _rows(index: DataFrame, mask: Column | None, where: Column | None, exclude_row: int | None) -> DataFrame:
    """The rows to score. A mask that is given replaces the index's own."""
    rows = index.filter(F.col("mask") if mask is None else mask)
    if where is not None:
        rows = rows.filter(where)
    return rows if exclude_row is None else rows.filter(F.col("row") != exclude_row)


def search(index: DataFrame, query: Sequence[float], k: float = 10, *, dim: int | None = None, mask: Column | None = None, where: Column | None = None, exclude_row: int | None = None, min_score: float | None = None) -> DataFrame:
    """The ``k`` best rows with their score. ``min_score`` cuts what is under it after the k best are taken."""
    q = _checked(query, dim)
    n = clamp_k(k, 2**31 - 1)
    score = round6(dot(F.col("codes"), vector(q)) * F.col("scale").cast("double"))
    found = _rows(index, mask, where, exclude_row).withColumn("score", score).drop("codes", "scale")
    best = found.orderBy(F.desc("score"), F.asc("row")).limit(n)
    return best if min_score is None else best.filter(F.col("score") >= min_score)


def search_arrow(index: DataFrame, query: Sequence[float], k: int = 10, *, mask: Column | None = None, exclude_row: int | None = None) -> DataFrame:
    """(row, id, score) as :func:`search` gives, by matrix products over Arrow batches."""
    q, n = np.array(_checked(query)), clamp_k(k, 2**31 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not n:
                continue
            codes = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            score = np.floor(codes.astype(float) @ q * batch.column(3).to_numpy().astype(float) * 1e6 + 0.5) / 1e6
            row = batch.column(0).to_numpy()
            best = np.lexsort((row, -score))[:n]
            yield pa.RecordBatch.from_arrays([pa.array(row[best]), batch.column(1).take(pa.array(best)), pa.array(score[best])], ["row", "id", "score"])

    rows = _rows(index, mask, None, exclude_row).select("row", "id", "codes", "scale")
    return rows.mapInArrow(run, "row long, id long, score double").orderBy(F.desc("score"), F.asc("row")).limit(n)


def score_floor(hits: DataFrame, least: float = 0.0, ratio: float = 0.0) -> DataFrame:
    """Hits (few: a top-k) not under ``least``, nor under ``ratio`` of the best."""
    best = hits.agg(F.max("score").alias("__best"))
    return hits.crossJoin(F.broadcast(best)).filter((F.col("score") >= least) & (F.col("score") >= F.col("__best") * ratio)).drop("__best")


def query_of(index: DataFrame, item: int) -> DataFrame:
    """The item's own vector, as one row (qrow, q) or none: masked and unknown items are no queries."""
    return index.filter((F.col("id") == item) & F.col("mask")).limit(1).select(F.col("row").alias("qrow"), dequantize(F.col("codes"), F.col("scale")).alias("q"))


def similar_to(index: DataFrame, item: int, k: float = 10, *, mask: Column | None = None) -> DataFrame:
    """The ``k`` rows nearest to an item of the index, itself left out."""
    own = F.broadcast(query_of(index, item))  # one row at most
    score = round6(dot(F.col("codes"), F.col("q")) * F.col("scale").cast("double"))
    found = _rows(index, mask, None, None).crossJoin(own).filter("row <> qrow").withColumn("score", score).drop("codes", "scale", "q", "qrow")
    return found.orderBy(F.desc("score"), F.asc("row")).limit(clamp_k(k, 2**31 - 1))


def rows_of(index: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, row): the row of each id that is asked for, null where the index has none."""
    return ids.select("id").join(index.select("id", "row"), "id", "left")


def search_level(levels: dict[str, DataFrame], level: str, query: Sequence[float], k: float = 10) -> DataFrame:
    """:func:`search` in the index of a level; an unknown one is an error."""
    if level not in levels:
        raise ValueError(f"the level is one of {', '.join(levels)}, not {level!r}")
    return search(levels[level], query, k)


def similar_many(index: DataFrame, items: Sequence[int], k: int = 10, *, depth_col: str = "rank") -> DataFrame:
    """(qid, rank, id, row, score) for each item of a stated set, in rounds of at most BATCH_QUERIES."""
    rounds = [list(items[i : i + BATCH_QUERIES]) for i in range(0, len(items), BATCH_QUERIES)] or [[]]
    out = None
    for part in rounds:
        asked = index.filter(F.col("id").isin(part) & F.col("mask"))
        q = F.broadcast(asked.select(F.col("id").alias("qid"), F.col("row").alias("qrow"), dequantize(F.col("codes"), F.col("scale")).alias("q")))
        score = round6(dot(F.col("codes"), F.col("q")) * F.col("scale").cast("double"))
        hit = index.filter("mask").crossJoin(q).filter("row <> qrow").select("qid", "id", "row", score.alias("score"))
        ranked = hit.withColumn(depth_col, F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("row")))).filter(F.col(depth_col) <= k)
        out = ranked if out is None else out.unionByName(ranked)
    return out


def neighbours_batch(index: DataFrame, queries: DataFrame, k: int = 10, *, block: int = BATCH_QUERIES, sent: int = SENT_BYTES) -> DataFrame:
    """(qid, rank, id, score) for a DataFrame (qid, qrow, q) of queries, by matrix products of tiles: ``block`` queries by TILE_ROWS rows.

    Up to ``sent`` bytes of queries go to all tasks at once, so 100,000 of 64 numbers are one job and one scan. A task keeps
    the k best of each query over all its batches and gives these at its end; a window keeps the k best of the tasks'. Only what is beyond
    those bytes is a job more, whose result is written, so neither the plan nor the driver grows with their number.
    """
    spark = index.sparkSession
    n, width = queries.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    jobs = max(1, -(-n * (8 * (width or 0) + 16) // sent))
    at = f"{folder(spark)}/granary-neighbours/{uuid4().hex}"
    for j in range(jobs):
        own = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(jobs)) == j).toArrow()
        qid, qrow = (own.column(c).to_numpy() for c in ("qid", "qrow"))
        q = own.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(qid), -1 if len(qid) else 0)
        told = spark.sparkContext.broadcast((qid, qrow, q))

        def run(batches: Iterator[pa.RecordBatch], told: object = told) -> Iterator[pa.RecordBatch]:
            qid, qrow, q = told.value
            best = [np.full((len(qid), k), -np.inf), np.full((len(qid), k), np.iinfo(np.int64).max), np.zeros((len(qid), k), np.int64)]
            for batch in batches:
                if not batch.num_rows or not len(qid):
                    continue
                codes = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1).T.astype(float)
                row, ids, scale = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_numpy().astype(float)
                for at in range(0, batch.num_rows, TILE_ROWS):
                    rows = slice(at, at + TILE_ROWS)
                    for lo in range(0, len(qid), block):
                        part = slice(lo, lo + block)
                        score = q[part] @ codes[:, rows]
                        score *= scale[rows]
                        score *= 1e6
                        score += 0.5
                        np.floor(score, out=score)
                        score /= 1e6
                        score[qrow[part, None] == row[rows]] = -np.inf
                        least = best[0][part, -1]  # what is under the k best so far, or of the tile, can't be among them
                        if score.shape[1] > k:
                            least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
                        who, which = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                        touched = np.unique(who)
                        if not len(touched):
                            continue
                        old = [b[part][touched].ravel() for b in best]
                        new = (score[who, which], row[rows][which], ids[rows][which])
                        owner = np.concatenate((np.repeat(touched, k), who))
                        found = [np.concatenate(x) for x in zip(old, new, strict=True)]
                        order = np.lexsort((found[1], -found[0], owner))
                        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
                        order = order[place < k]
                        for b, x in zip(best, found, strict=True):
                            b[part][touched] = x[order].reshape(len(touched), k)
            for lo in range(0, len(qid), block):
                score, row, ids = (b[lo : lo + block].ravel() for b in best)
                ok = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid[lo : lo + block], k)[ok]), pa.array(row[ok]), pa.array(ids[ok]), pa.array(score[ok])], ["qid", "row", "id", "score"])

        part = index.filter("mask").select("row", "id", "codes", "scale").mapInArrow(run, "qid long, row long, id long, score double")
        ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("row"))))
        best = ranked.filter(F.col("rank") <= k).select("qid", "rank", "id", "score")
        if jobs == 1:
            return best
        best.write.mode("append").parquet(at)
    return spark.read.parquet(at)


def multi_query_search(index: DataFrame, queries: Sequence[Sequence[float]], k: int = 20, depth: int = 40, *, where: Column | None = None) -> DataFrame:
    """(row, score): the sum over queries of 1 / (60 + rank) among each one's ``depth`` best; not rounded, ties by row."""
    lists = None
    for n, q in enumerate(queries):
        hits = search(index, q, depth, where=where).select("row", "score", F.lit(n).alias("n"))
        lists = hits if lists is None else lists.unionByName(hits)
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), F.asc("row"))))
    # few rows; in the order of the queries, so that the sums of doubles are always the same
    voted = ranked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("n", (1.0 / (RRF_OFFSET + F.col("rank"))).alias("w")))).alias("ws"))
    summed = voted.select("row", F.aggregate("ws", F.lit(0.0), lambda s, x: s + x["w"]).alias("score"))
    return summed.orderBy(F.desc("score"), F.asc("row")).limit(clamp_k(k, 2**31 - 1))


def project_index(vectors: DataFrame, id_col: str, components: list[list[float]], mean: list[float], vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"), project(F.col(vector_col), components, mean).alias("v"))


__all__ = ["build_index", "multi_query_search", "neighbours_batch", "project_index", "query_of", "score_floor", "search", "search_arrow", "similar_many", "similar_to"]
