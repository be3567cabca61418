"""Toxicity by multiple-instance learning: a document is toxic if a sentence is.

A sentence's chance is a logistic function of the weights of its distinct words; a word weighs what it and its prefixes
of four and five letters have been given, so unseen forms of a known stem count. The document's chance is the noisy-or
of its sentences that hold anything with a weight, and of one leak a document for what no weight explains; so the length
of a clean text adds nothing. Only document labels are needed to fit all of it by gradient descent. What may have a weight
is settled first: every word and prefix that toxic documents of the sample have far more often than others do, by
``LEAST`` and ``ABOVE``. These two and ``RIDGE`` were chosen on the folds that are learned from.

Fitting uses at most ``SAMPLE`` labelled documents (a parameter), of which only the sentences' chosen features reach the
driver. Scoring covers whole texts and every row; it also says which sentences offend, and how much.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import arrow_scalar, by_place, columns_kept, give_back, map_slices, read, ship
from granary.llm.labels import fold, sample

SAMPLE, STEPS = 8_000, 400
#: A feature stands in so many toxic documents at least, by so many standard deviations more than its share; and the
#: penalty on squared weights, by which forms of a stem share theirs.
LEAST, ABOVE, RIDGE = 3, 2.5, 3e-4
_WORD, _SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"[^.!?\n]+")
_CACHE = 200_000


def features(word: str) -> list[str]:
    """The word and its prefixes; a mark tells them apart."""
    return [word, *(word[:n] + "*" for n in (4, 5) if len(word) > n)]


def _document_features(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts: Counter[tuple[str, int]] = Counter()
    for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        counts.update((f, y) for f in {f for w in set(_WORD.findall(text.lower())) for f in features(w)})
    keys = list(counts)
    return pa.RecordBatch.from_arrays([pa.array([f for f, _ in keys], pa.string()), pa.array([y for _, y in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], ["f", "y", "n"])


def _chosen(rows: DataFrame, n_pos: int, n_neg: int, least: int, above: float) -> list[str]:
    """The features whose count in toxic documents is that far above what the others' share would give."""
    counted = map_slices(rows, "text", _document_features, "f string, y int, n long")
    both = counted.groupBy("f").agg(F.sum(F.col("n") * F.col("y")).alias("pos"), F.sum(F.col("n") * (1 - F.col("y"))).alias("neg"))
    due = (F.col("neg") + 0.5) * (n_pos / max(1, n_neg))
    z = (F.col("pos") - due) / F.sqrt(F.col("pos") + due)
    top = both.filter(F.col("pos") >= least).withColumn("z", z).filter(F.col("z") > above).orderBy(F.desc("z"), "f")
    return [r[0] for r in top.select("f").collect()]  # of a bounded sample, those that stand in toxic texts only


def _sentences(index: dict[str, int]) -> Any:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, hits = [], []
        for text in batch.column(0).to_pylist():
            found = [s for s in _SENTENCE.findall(text.lower()) if _WORD.search(s)]
            n.append(len(found))
            kept = ([index[f] for w in sorted(set(_WORD.findall(s))) for f in features(w) if f in index] for s in found)
            hits.append([k for k in kept if k])
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.list_(pa.int32())))], ["y", "n", "hits"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = SAMPLE, steps: int = STEPS, least: int = LEAST, above: float = ABOVE, ridge: float = RIDGE, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, float], float, float]:
    """Weights by feature, the bias of a sentence, and the leak of a document. Without labels of both kinds nothing weighs anything."""
    ship(docs.sparkSession)
    drawn, sizes = sample(docs, labels, "toxic", rows, id_col, text_col)
    got = {r[0]: r[1] for r in drawn.groupBy("y").count().collect()}  # two rows
    if not got.get(0) or not got.get(1):
        return {}, -12.0, -12.0
    chosen = _chosen(drawn, got[1], got[0], least, above)
    index = {f: i for i, f in enumerate(chosen)}
    table = map_slices(drawn, "text", _sentences(index), "y int, n long, hits array<array<int>>").toArrow()  # at most ``rows`` short rows
    y, full = table.column("y").to_numpy(), (table.column("n").to_numpy() > 0).astype(float)
    by_doc = table.column("hits").combine_chunks()
    by_sentence = by_doc.flatten()
    feat_ = by_sentence.flatten().to_numpy().astype(np.int64)
    doc_ = np.repeat(np.arange(len(y)), np.diff(by_doc.offsets.to_numpy()))
    sent_ = np.repeat(np.arange(len(doc_)), np.diff(by_sentence.offsets.to_numpy()))
    del table, by_doc, by_sentence
    weight = np.where(y == 1, sizes[1] / got[1], sizes[0] / got[0])
    weight /= weight.sum()
    w, b, leak = np.zeros(len(chosen)), -6.0, -4.0
    m, v = np.zeros(len(chosen) + 2), np.zeros(len(chosen) + 2)
    plus = lambda z: np.logaddexp(0, z)
    for step in range(1, steps + 1):
        z = b + np.bincount(sent_, w[feat_], len(doc_))
        total = full * plus(leak) + np.bincount(doc_, plus(z), len(y))
        slope = weight * np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1)
        dz = slope[doc_] / (1 + np.exp(-z))
        grad = np.append(np.bincount(feat_, dz[sent_], len(chosen)) + ridge * w, [dz.sum(), (slope * full).sum() / (1 + np.exp(-leak))])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b, leak = w - move[:-2], b - move[-2], leak - move[-1]
    del feat_, doc_, sent_, y, full, weight
    give_back()
    return {f: float(x) for f, x in zip(chosen, w, strict=True)}, float(b), float(leak)


_SCORED = "struct<score: double, sentences: array<struct<start: int, end: int, p: double>>>"
_SCORED_ARROW = pa.struct([("score", pa.float64()), ("sentences", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))])


def score_column(text: Column, weights: dict[str, float], bias: float, leak: float, offends: float = 0.5) -> Column:
    """score: the noisy-or over sentences; sentences: those of a chance of ``offends`` or more, by code points.

    A null or empty text, and one without words, has no sentence and scores 0.
    """
    known: dict[str, float] = {}

    def weigh(word: str) -> float:
        x = known[word] = sum(weights.get(f, 0.0) for f in features(word))
        return x

    def run(col: pa.Array) -> pa.Array:
        out = []
        rest = float(np.logaddexp(0, leak))
        for text in col.to_pylist():
            if len(known) > _CACHE:  # between documents only
                known.clear()
            low = (text or "").lower()
            words = set(_WORD.findall(low))
            hit = {w: x for w in words if (x := known[w] if w in known else weigh(w))}
            if not hit:
                out.append((float(-np.expm1(-rest)) if words else 0.0, []))
                continue
            total, found = rest, []
            for s in _SENTENCE.finditer(text):
                own = set(_WORD.findall(s[0].lower()))
                if own & hit.keys():
                    z = bias + sum(hit[w] for w in sorted(own & hit.keys()))
                    total += float(np.logaddexp(0, z))
                    p = 1 / (1 + float(np.exp(-z)))
                    if p >= offends:
                        found.append({"start": s.start(), "end": s.end(), "p": p})
            out.append((float(-np.expm1(-total)), found))
        return pa.array([{"score": s, "sentences": f} for s, f in out], _SCORED_ARROW)

    return arrow_scalar(run, _SCORED)(text)


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how: Any) -> DataFrame:
    """(doc_id, score, sentences): a row for each row of ``docs``; repeated rows repeat. ``how`` goes to :func:`fit`."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **how)
    own = columns_kept(docs, {"doc_id": id_col, "text": text_col})
    return own.select("doc_id", score_column(F.col("text"), *model).alias("s")).select("doc_id", "s.score", "s.sentences")


def without_toxic(docs: DataFrame, labels: DataFrame, *, at: float = 0.5, rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``at`` or more; all columns stay. Null and empty texts stay, and repeated rows
    stay or go together."""
    model = fit(docs, labels, rows=rows, id_col=id_col, text_col=text_col)
    own, named = by_place(docs)
    scored = own.withColumn("toxicity", score_column(F.col(named(text_col)), *model))
    return scored.filter(F.col("toxicity.score") < at).drop("toxicity").toDF(*docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
