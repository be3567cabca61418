"""Exact top-k search by inner product with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it, and the index is range-partitioned and sorted by
(pivot, distance, id): a hot pivot's vectors so lie in many partitions, each with an annulus of it. A partition is read
in runs of at most ``ANNULUS`` rows of one pivot. For a query at distance d from the pivot, the triangle inequality gives
every vector at distance r from it |q - v| >= |d - r|, so q.v <= (|q|^2 + max|v|^2 - (d - r)^2) / 2. From the annulus
where d falls, the search expands outwards on both sides and stops for a query once this bound is under its k-th best
score so far. That threshold, a score and an id, starts from a first pass in which each query looks at the rows next to its
own place and at one of ``STRIDE`` rows elsewhere, of which each partition tells the best few; of equal scores only those
with a smaller id get past it, so neither partitions nor ties multiply what the second pass gives.

Queries are a stated set and go in blocks of at most ``BLOCK`` to all partitions; a block, its distances from the pivots
and its thresholds are what is broadcast. Pivots come from a bounded sample; every row is indexed, and the bounds are
exact, so the sample bears on speed alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from granary.llm.common import columns_kept, cut, parts, read, ship

PIVOTS, SAMPLE, ANNULUS, BLOCK, NEAR, STRIDE = 64, 4096, 256, 20_000, 512, 8
_RESULT = "query_id long, vec_id long, score long"


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of integers; shorter vectors are filled with zeros, as inner products go."""
    lengths = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of integers; in doubles where these hold every sum exactly."""
    return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64) if exact else a @ b.T


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    v, p = v.astype(float), pivots.astype(float)
    return np.sqrt(np.maximum((v * v).sum(1)[:, None] + (p * p).sum(1) - 2 * (v @ p.T), 0))


def spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` pivots of a sample: first the row farthest from the mean, then always the one farthest from all so far."""
    if not len(sample):
        return sample
    far = ((sample - sample.mean(0)) ** 2).sum(1).astype(float)
    chosen = [int(far.argmax())]
    near = ((sample - sample[chosen[0]]) ** 2).sum(1).astype(float)
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _keyed(pivots: np.ndarray, dim: int) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_matrix(batch.column(1), dim), pivots)
            cell = d.argmin(1) if len(d) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["vec_id", "codes", "cell", "r"])

    return run


class Search:
    """A block of queries and the best that one partition has for each so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, floor: np.ndarray, tie: np.ndarray, k: int, exact: bool) -> None:
        self.ids, self.vectors, self.k, self.exact = ids, vectors, k, exact
        self.away = _distances(vectors, pivots)
        self.home = self.away.argmin(1) if len(pivots) else np.zeros(len(ids), int)
        self.norm = (vectors.astype(float) ** 2).sum(1)
        self.floor, self.tie = floor.copy(), tie.copy()
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def _score(self, who: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        if not len(who):
            return
        s = _products(self.vectors[who], v, self.exact)
        floor = self.floor[who][:, None]
        q, j = np.nonzero(((s > floor) | (s == floor) & (ids <= self.tie[who][:, None])) & (ids != self.ids[who][:, None]))
        self.found.append((who[q], ids[j], s[q, j]))
        self.held += len(q)
        if self.held > 400_000:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keep each query's k best, ties to the smaller id, and raise its threshold to the last of k."""
        q, i, s = (np.concatenate(x) for x in zip(*self.found, strict=True)) if self.found else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        new = np.append(True, (q[1:] != q[:-1]) | (i[1:] != i[:-1]))[: len(q)]  # the first pass may meet a row twice
        q, i, s = q[new], i[new], s[new]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        q, i, s, rank = q[keep], i[keep], s[keep], rank[keep]
        last = rank == self.k - 1
        who, score, name = q[last], s[last], i[last]
        better = (score > self.floor[who]) | (score == self.floor[who]) & (name < self.tie[who])
        self.floor[who[better]], self.tie[who[better]] = score[better], name[better]
        self.found, self.held = [(q, i, s)], len(q)
        return q, i, s

    def near(self, cell: int, r: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        """Queries of this cell against the rows beside their own distance, if it falls among these."""
        own = np.flatnonzero((self.home == cell) & (self.away[:, cell] >= r[0] - 1e-6) & (self.away[:, cell] <= r[-1] + 1e-6))
        at = np.searchsorted(r, self.away[own, cell])
        for lo in range(0, len(r), NEAR):
            self._score(own[(at >= lo) & (at < lo + NEAR) | (at == len(r)) & (lo + NEAR >= len(r))], ids[lo : lo + NEAR], v[lo : lo + NEAR])

    def expand(self, cell: int, r: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        """All queries against the annuli of one run of rows, outwards until the bound ends it."""
        most = (v.astype(float) ** 2).sum(1).max()
        d = self.away[:, cell]
        cuts = range(0, len(r), ANNULUS)
        place = np.searchsorted(r[list(cuts)][1:], d, "right")  # the annulus that d falls in
        for up in (True, False):
            alive = np.ones(len(self.ids), bool)
            for a in range(len(cuts)) if up else reversed(range(len(cuts))):
                lo, hi = a * ANNULUS, min((a + 1) * ANNULUS, len(r))
                due = np.flatnonzero(alive & ((place <= a) if up else (place > a)))
                gap = np.maximum(0, np.maximum(r[lo] - d[due], d[due] - r[hi - 1]))
                bound = (self.norm[due] + most - gap * gap) / 2
                # Distances are sums that cancel: their squares err by a part of the norms, not of the bound.
                ok = bound + 1e-6 * (1 + self.norm[due] + most) >= self.floor[due]
                alive[due[~ok]] = False
                self._score(due[ok], ids[lo:hi], v[lo:hi])


def _scan(sent: Any, dim: int, first: int) -> Any:
    """The best that a partition has for each query; in the first pass, the best ``first`` of those looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*sent.value)
        for batch in batches:
            cells, r, ids = (batch.column(i).to_numpy() for i in (2, 3, 0))
            v = _matrix(batch.column(1), dim)
            edges = np.flatnonzero(np.diff(cells, prepend=-1, append=-1))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                (search.near if first else search.expand)(int(cells[lo]), r[lo:hi], ids[lo:hi], v[lo:hi])
            if first:
                for lo in range(0, len(ids), STRIDE * ANNULUS):
                    search._score(np.arange(len(search.ids)), ids[lo : lo + STRIDE * ANNULUS : STRIDE], v[lo : lo + STRIDE * ANNULUS : STRIDE])
            search.reduce()
        q, i, s = search.reduce()
        if first:
            kept = np.arange(len(q)) - np.searchsorted(q, q) < first
            q, i, s = q[kept], i[kept], s[kept]
        yield pa.RecordBatch.from_arrays([pa.array(search.ids[q]), pa.array(i), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, is_query: Column, *, k: int = 20, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) from (vec_id: long, codes: array<long>): each query's k best of all other ids.

    Rows with a null id or vector take no part. Vectors of unlike length are filled with zeros. Rows that share an id
    are one vector, that with the least codes. Ties go to the smaller id. No queries, or no other rows, give no rows, nor does
    an empty table. Other columns must not be named like those that are read.
    Scores are exact while inner products fit 64 bits.
    """
    spark = ship(rows.sparkSession)
    rows = rows.filter("vec_id IS NOT NULL AND codes IS NOT NULL")
    magnitude = F.coalesce(F.array_max(F.transform("codes", F.abs)), F.lit(0))
    seen = rows.agg(F.count("*"), F.countDistinct("vec_id"), F.max(F.size("codes")), F.max(magnitude)).first()
    n, distinct, dim = seen[0], seen[1], seen[2] or 0
    if n != distinct:
        rows = rows.groupBy("vec_id").agg(F.min("codes").alias("codes"))
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    exact = dim * float(seen[3]) ** 2 < 2**53
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("codes").toArrow().column("codes").combine_chunks()
    points = spread_out(_matrix(drawn, dim), pivots)
    keyed = rows.select("vec_id", "codes").mapInArrow(_keyed(points, dim), "vec_id long, codes array<long>, cell int, r double")
    index = cut(keyed.repartitionByRange(parts(spark), "cell", "r", "vec_id").sortWithinPartitions("cell", "r", "vec_id"))
    asked = index.filter(is_query).select("vec_id", "codes")
    blocks = -(-asked.count() // block)
    results = []
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        ids = own.column("vec_id").to_numpy().astype(np.int64)
        vectors = _matrix(own.column("codes").combine_chunks(), dim) if len(ids) else np.zeros((0, dim), np.int64)
        floor, tie = np.full(len(ids), np.iinfo(np.int64).min), np.full(len(ids), np.iinfo(np.int64).max)
        sent = spark.sparkContext.broadcast((ids, vectors, points, floor, tie, k, exact))
        first = index.mapInArrow(_scan(sent, dim, max(1, -(-2 * k // index.rdd.getNumPartitions()))), _RESULT)
        ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        known = ranked.filter(F.col("n") == k).select("query_id", "score", "vec_id").toArrow()  # a row for each query of the block at most
        place = {q: i for i, q in enumerate(ids.tolist())}
        for q, s, i in zip(*(known.column(c).to_pylist() for c in ("query_id", "score", "vec_id")), strict=True):
            floor[place[q]], tie[place[q]] = s, i
        sent = spark.sparkContext.broadcast((ids, vectors, points, floor, tie, k, exact))
        best = index.mapInArrow(_scan(sent, dim, 0), _RESULT)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        best = best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        results.append(cut(best) if blocks > 1 else best)
    out = results[0] if results else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def integer_codes(rows: DataFrame, *, by: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, codes): floor(by * x) of each component as a double; codes are null where a component is null or not finite."""
    own = columns_kept(rows, {"vec_id": id_col, "v": vector_col})
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    codes = F.transform("v", lambda x: F.floor(F.lit(by) * x.cast(T.DoubleType())).cast("long"))
    return own.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("v").isNotNull() & ~bad, codes).alias("codes"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(integer_codes(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.c, v.c)::BIGINT AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""
