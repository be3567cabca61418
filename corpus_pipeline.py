"""From raw documents to tokens: five stages, each written as Parquet and read again as the next one's documents.

All but the last return the columns of ``documents``, under their names and in their order, whatever extra columns there
are. Rows whose text is null or empty score no toxicity and hold no benchmark window and no personal data; the near-dedup
stage counts them as copies of one another. Rows without an id are named by nothing and stay. Of rows that repeat an id
that stays, the near-dedup stage keeps one; all else that no stage rejects comes through once. Which of several equal
documents stays is settled by the smallest id. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bpe, decontaminate, pii, simhash, toxicity
from granary.llm.common import read, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is 0.5 or more go; the classifier is fitted to the labels of the documents given."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash fingerprints (op9), or by a Jaccard similarity of 0.8 or more on shingles of five words, that of
    the smallest id stays: what fingerprints of 3 bits can't tell, the exact similarity adds."""
    return simhash.deduplicate(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars follows the text."""
    made = pii.pseudonymise(docs, key=pii.key_of(spark))
    own = made.toDF(*map(str, range(len(made.columns))))
    text = F.col(str(made.columns.index("text")))
    sizes = [F.length(text).cast(t).alias(c) if n == "n_chars" else F.col(c) for n, c, (_, t) in zip(made.columns, own.columns, own.dtypes, strict=True)]
    return own.select(*sizes).toDF(*made.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the tokens of each document, checked by decoding them."""
    return bpe.round_trip(docs, bpe.tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("pii", hide_personal_data),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole of ``documents``.

    What stands between them is written to the shared folder. A stage's output goes once the next one's is written; that
    of the last but one, which the result reads, when the application ends.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(path)
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        at = f"{path.toString()}/{k}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if k:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path.toString()}/{k - 1}"), True)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can fit no classifier and encode no tokens; tests hold the stages against plain versions instead.
ORACLE_SQL = None
