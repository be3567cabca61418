"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import columns_kept, cut

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; labels are learned from no row where this is 0."""
    return F.crc32(doc_id.cast("string")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(text, y) of at most ``rows`` labelled documents outside the held-out fold, half of each label at most, and the
    number of labelled rows by label.

    Which ones is settled by a hash of the id, so every partition of the corpus and every label has its share. Labels
    other than 0 and 1 are left out; a document with several labels has the largest. Equal texts count once.
    """
    own = columns_kept(labels, {"doc_id": "doc_id", "y": target}).filter("doc_id IS NOT NULL AND y IN (0, 1)")
    own = own.filter(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    sizes = {r[0]: r[1] for r in own.groupBy("y").count().collect()}  # two rows
    order = [F.xxhash64("doc_id"), "doc_id"]
    drawn = own.filter("y = 0").orderBy(*order).limit(rows // 2).unionByName(own.filter("y = 1").orderBy(*order).limit(rows // 2))
    drawn = drawn.withColumnRenamed("doc_id", "__id")
    texts = columns_kept(docs, {"doc_id": id_col, "text": text_col})
    met = texts.join(F.broadcast(drawn), texts.doc_id == F.col("__id")).select(F.coalesce("text", F.lit("")).alias("text"), "y")  # at most ``rows`` ids
    return cut(met.groupBy(F.xxhash64("text").alias("h")).agg(F.max_by("text", "y").alias("text"), F.max("y").alias("y")).select("text", "y")), sizes
