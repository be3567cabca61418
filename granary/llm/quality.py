"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's evidence is what its own characters and words look like and what those of its two
neighbours look like; the chain adds how readily labels follow each other. Only documents have labels: lines start with
their document's, and after each fit the lines of bad documents that look good are counted as good for the next. A
document's quality is the mean of its lines' forward-backward marginals weighted by length, put on the scale of chances
by a logistic curve fitted to the same documents.

Fitting uses at most ``SAMPLE`` labelled documents and about ``LINES`` of their lines (parameters), in chains of at most
``CHAIN`` lines: a longer document is several. Which chains is settled by a hash, so long and short documents have their
share. Scoring covers whole texts, each as one chain.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import arrow_scalar, columns_kept, give_back, map_slices, read, ship
from granary.llm.labels import fold, sample

SAMPLE, LINES, CHAIN, ROUNDS, STEPS = 4_000, 60_000, 1_000, 3, 100
#: Cells of a padded group of documents that a pass works on at once.
_CELLS = 200_000
_KINDS = 6
_OWN = 13


@lru_cache(1)
def _kinds() -> np.ndarray:
    """0 letter or continuation byte, 1 upper-case, 2 digit, 3 white space, 4 sentence punctuation, 5 other symbol."""
    b = np.arange(256)
    kind = np.full(256, 5, np.uint8)
    kind[(b >= 0x61) & (b <= 0x7A) | (b >= 0x80)] = 0
    kind[(b >= 0x41) & (b <= 0x5A)] = 1
    kind[(b >= 0x30) & (b <= 0x39)] = 2
    kind[(b == 0x20) | (b >= 9) & (b <= 13)] = 3
    for c in b".,;:'\"?()-":
        kind[c] = 4
    return kind


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A row for each line that isn't blank, without its neighbours' part, and the lines' lengths in characters."""
    lines = [s for s in text.split("\n") if s.strip()]
    out = np.zeros((len(lines), _OWN), np.float32)
    if not lines:
        return out, np.zeros(0)
    raw = [s.encode() for s in lines]
    size = np.array([len(b) for b in raw])
    kind = _kinds()[np.frombuffer(b"".join(raw), np.uint8)]
    at = np.concatenate(([0], np.cumsum(size)))[:-1]
    for k in range(_KINDS):
        out[:, k] = np.add.reduceat((kind == k).astype(np.int32), at) / size
    seen: dict[str, int] = {}
    for i, s in enumerate(lines):
        words = s.split()
        n = len(words)
        out[i, 6] = np.log1p(n) / 5
        out[i, 7] = min(1.0, size[i] / n / 20)
        out[i, 8] = len(set(words)) / n
        out[i, 9] = sum(map(str.__eq__, words, words[1:])) / n
        out[i, 10] = sum(map(_odd, words)) / n
        out[i, 11] = float(s in seen)
        seen[s] = 1
    out[:, 12] = 1
    return out, np.array([len(s) for s in lines], float)


def _odd(word: str) -> bool:
    """A word without a letter or digit, or one that ends in a symbol."""
    return not word[-1].isalnum() and word[-1] not in ".,;:'\"?)-"


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Each line's features, its squares for the shares, and those of the lines before and after (zeros at the ends)."""
    own = np.hstack([x, x[:, : _OWN - 1] ** 2])
    none = np.zeros((1, _OWN), x.dtype)
    return np.hstack([own, np.vstack([none, x[:-1]]), np.vstack([x[1:], none])])


WIDTH = 2 * _OWN - 1 + 2 * _OWN


def _lse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def chain(unary: np.ndarray, n: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of "good" by forward-backward over padded chains; with ``pairs`` also the expected moves of each.

    ``unary`` (chains, lines): the score of good against bad; ``n``: the chains' lengths; ``moves`` (2, 2): from, to.
    """
    d, t = unary.shape
    f0, f1 = np.zeros((t, d)), np.zeros((t, d))
    b0, b1 = np.zeros((t, d)), np.zeros((t, d))
    f1[0] = unary[:, 0]
    for i in range(1, t):
        f0[i] = _lse(f0[i - 1] + moves[0, 0], f1[i - 1] + moves[1, 0])
        f1[i] = _lse(f0[i - 1] + moves[0, 1], f1[i - 1] + moves[1, 1]) + unary[:, i]
    for i in range(t - 2, -1, -1):
        live = i + 1 < n
        z0 = _lse(moves[0, 0] + b0[i + 1], moves[0, 1] + unary[:, i + 1] + b1[i + 1])
        z1 = _lse(moves[1, 0] + b0[i + 1], moves[1, 1] + unary[:, i + 1] + b1[i + 1])
        b0[i], b1[i] = np.where(live, z0, 0), np.where(live, z1, 0)
    good = 1 / (1 + np.exp(np.clip(f0 + b0 - f1 - b1, -60, 60)))
    if not pairs:
        return good.T, None
    last = n - 1
    total = _lse(f0[last, np.arange(d)], f1[last, np.arange(d)])
    expected = np.zeros((2, 2))
    live = np.arange(1, t)[:, None] < n
    for a, fa in enumerate((f0, f1)):
        for b, (bb, u) in enumerate(((b0, 0), (b1, unary.T[1:]))):
            expected[a, b] = np.exp(np.minimum(fa[:-1] + moves[a, b] + u + bb[1:] - total, 0))[live].sum()
    return good.T, expected


def _groups(sizes: np.ndarray) -> list[np.ndarray]:
    """Chains of like length together, so that padding stays small."""
    order = np.argsort(sizes, kind="stable")
    out, lo = [], 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * sizes[order[hi]] <= _CELLS:
            hi += 1
        out.append(order[lo:hi])
        lo = hi
    return out


@dataclass
class Model:
    theta: np.ndarray
    moves: np.ndarray
    slope: float
    shift: float

    def means(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray]]:
        """The length-weighted mean of the marginals, and these, for each document's (features, lengths)."""
        out: list[tuple[float, np.ndarray]] = [(0.0, np.zeros(0))] * len(docs)
        full = [i for i, (x, _) in enumerate(docs) if len(x)]
        sizes = np.array([len(docs[i][0]) for i in full], int)
        for group in _groups(sizes):
            n = sizes[group]
            unary = np.zeros((len(group), n.max()))
            for j, g in enumerate(group):
                unary[j, : n[j]] = with_neighbours(docs[full[g]][0]) @ self.theta
            good, _ = chain(unary, n, self.moves)
            for j, g in enumerate(group):
                p, w = good[j, : n[j]], docs[full[g]][1]
                out[full[g]] = float((p * w).sum() / w.sum()), p
        return out

    def scale(self, mean: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * mean + self.shift, -60, 60))))


def _adam(grad: Any, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, steps + 1):
        g = grad(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return x


def targets(good: np.ndarray, n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What lines are taken to be: those of good documents good, those of bad ones as they seem, but the worst of each is bad.
    Chains that share a group are padded to its longest; ``n`` are their own lengths, and no place beyond counts."""
    live = np.arange(good.shape[1]) < n[:, None]
    out = np.where((y == 0)[:, None], (good > 0.5).astype(float), 1.0)
    bad = np.flatnonzero(y == 0)
    out[bad, np.where(live, good, 2.0).argmin(1)[bad]] = 0
    return out


def train(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS, steps: int = STEPS) -> Model:
    sizes = np.array([len(x) for x, _ in docs], int)
    groups = [(g, sizes[g]) for g in _groups(sizes)]
    padded = []
    for g, n in groups:
        x = np.zeros((len(g), n.max(), WIDTH), np.float32)
        for j, i in enumerate(g):
            x[j, : n[j]] = with_neighbours(docs[i][0])
        padded.append(x)
    labels = [np.repeat(y[g][:, None], x.shape[1], 1).astype(float) for (g, _), x in zip(groups, padded, strict=True)]
    params = np.zeros(WIDTH + 4)
    lines = float((weight * sizes).sum())

    def slope(p: np.ndarray) -> np.ndarray:
        theta, moves, out = p[:WIDTH], p[WIDTH:].reshape(2, 2), 1e-4 * p
        for (g, n), x, t in zip(groups, padded, labels, strict=True):
            # chains of one weight go together, as expected moves come summed
            for w in np.unique(weight[g]):
                k = weight[g] == w
                good, expected = chain(x[k] @ theta, n[k], moves, pairs=True)
                live = np.arange(x.shape[1]) < n[k][:, None]
                out[:WIDTH] += w / lines * np.einsum("dt,dtf->f", (good - t[k]) * live, x[k])
                pair = np.zeros((2, 2))
                after = live[:, 1:]
                a, b = t[k][:, :-1], t[k][:, 1:]
                pair[0, 0], pair[0, 1], pair[1, 0], pair[1, 1] = (((1 - a) * (1 - b))[after].sum(), ((1 - a) * b)[after].sum(), (a * (1 - b))[after].sum(), (a * b)[after].sum())
                out[WIDTH:] += w / lines * (expected - pair).ravel()
        return out

    for r in range(rounds):
        params = _adam(slope, params, steps, 0.1 if r == 0 else 0.03)
        if r + 1 < rounds:
            theta, moves = params[:WIDTH], params[WIDTH:].reshape(2, 2)
            for (g, n), x, t in zip(groups, padded, labels, strict=True):
                good, _ = chain(x @ theta, n, moves)
                t[:] = targets(good, n, y[g])
    model = Model(params[:WIDTH], params[WIDTH:].reshape(2, 2), 1.0, 0.0)
    mean = np.array([m for m, _ in model.means(docs)])
    w = weight / weight.sum()

    def curve(p: np.ndarray) -> np.ndarray:
        e = w * (1 / (1 + np.exp(-np.clip(p[0] * mean + p[1], -60, 60))) - y)
        return np.array([(e * mean).sum() + 1e-3 * p[0] * 1e-2, e.sum()])

    a, b = _adam(curve, np.array([4.0, -2.0]), 600, 0.1)
    del padded, labels
    give_back()
    return Model(model.theta, model.moves, max(float(a), 0.1), float(b))


def _sampled(share: float, most: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Chains of ``most`` lines at most; of all of them a ``share``, by a hash of the text and the chain's place."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        from xxhash import xxh64_intdigest

        keys, ys, xs, ns = [], [], [], []
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, n = line_features(text)
            for k, lo in enumerate(range(0, len(n), most)):
                key = xxh64_intdigest(text.encode(), k)
                if key < share * 2.0**64:
                    keys.append(key >> 1)
                    ys.append(y)
                    xs.append(x[lo : lo + most].ravel())
                    ns.append(n[lo : lo + most])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ys, pa.int32()), pa.array(xs, pa.list_(pa.float32())), pa.array(ns, pa.list_(pa.float64()))], ["key", "y", "x", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE, lines: int = LINES, chain_lines: int = CHAIN, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The model, or None where labelled texts of both kinds are lacking."""
    ship(docs.sparkSession)
    drawn, sizes = sample(docs, labels, "quality", rows, id_col, text_col)
    held = drawn.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    sampled = map_slices(drawn, "text", _sampled(lines / max(lines, held), chain_lines), "key long, y int, x array<float>, n array<double>")
    table = sampled.orderBy("key", "y").toPandas()  # about ``lines`` lines
    found = [(np.asarray(x, np.float32).reshape(-1, _OWN), np.asarray(n, float)) for x, n in zip(table["x"], table["n"], strict=True)]
    ys = table["y"].to_numpy(int)
    if not len(ys) or ys.min() == ys.max():
        return None
    weight = np.where(ys == 1, sizes[1] / (ys == 1).sum(), sizes[0] / (ys == 0).sum())
    return train(found, ys, weight / weight.mean())


_SCORED = "struct<score: double, lines: array<double>>"


def score_column(text: Column, model: Model | None) -> Column:
    """score, and each non-blank line's chance of being good. A text without such lines scores 0; without a model all
    others score 0.5."""

    def run(col: pa.Array) -> pa.Array:
        docs = [line_features(t or "") for t in col.to_pylist()]
        if model is None:
            rows = [{"score": 0.5 if len(n) else 0.0, "lines": []} for _, n in docs]
        else:
            rows = [{"score": model.scale(m) if len(p) else 0.0, "lines": p} for m, p in model.means(docs)]
        return pa.array(rows, pa.struct([("score", pa.float64()), ("lines", pa.list_(pa.float64()))]))

    return arrow_scalar(run, _SCORED)(text)


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how: Any) -> DataFrame:
    """(doc_id, score, lines): a row for each row of ``docs``; repeated rows repeat. ``how`` goes to :func:`fit`.

    Null and empty texts score 0, a null id stays null. All lines of a text count, however many. Other columns don't matter, whatever
    their names. An empty table gives no rows; without labels of both kinds all texts with a line score 0.5.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **how)
    own = columns_kept(docs, {"doc_id": id_col, "text": text_col})
    return own.select("doc_id", score_column(F.col("text"), model).alias("s")).select("doc_id", "s.score", "s.lines")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
