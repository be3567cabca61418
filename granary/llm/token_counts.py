"""Token counts of whole texts under a sentencepiece model: Arrow functions that return lengths only.

A boundary between two characters is safe if no piece of the vocabulary holds both of them in a row: no merge can cross
it, so the counts on both sides add up. Texts longer than ``PIECE_CHARS`` are split at such places, before a space that
follows another character or before a line break; that the model's pieces don't cross them is checked when it is read.
Pieces of many texts go to the library in batches of about ``BATCH_BYTES`` bytes, so that no call holds the tokens of more
than that, and only the sums leave the function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import arrow_scalar, columns_kept, read, ship

LIMIT = 4096
PIECE_CHARS, BATCH_BYTES = 1 << 16, 1 << 20
#: The library writes a space as this mark, which a text may hold as well.
_MARK = "\u2581"
_SAFE = re.compile(rf"(?<=[^ {_MARK}]) |\n")


class Counter:
    """Counts tokens as the library's ``encode`` gives them, without begin and end tokens."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = "  a  b\tc\nd \ufb01\u2460  "
        if any(_MARK in p.lstrip(_MARK) or " " in p or "\n" in p for p in pieces) or self.model.decode(self.model.encode(probe)) != probe:
            raise ValueError(f"{path}: its pieces cross spaces or line breaks, or it rewrites texts; no boundary would be safe")

    @staticmethod
    def pieces(text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE_CHARS and (found := _SAFE.search(text, at + PIECE_CHARS)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def _lengths(self, batch: list[tuple[int, str]], sums: list[int], firsts: list[bool]) -> None:
        """The library puts a space before what it encodes. That stands for the first space of a piece that goes on
        with a text; before a piece that starts with a line break it is a token that doesn't count."""
        bare = [p if first or p[0] != " " else p[1:] for (_, p), first in zip(batch, firsts, strict=True)]
        for (i, p), first, b, ids in zip(batch, firsts, bare, self.model.encode(bare, num_threads=1), strict=True):
            sums[i] += len(ids) if first else (len(ids) if b else 1) if p[0] == " " else len(ids) - 1

    def count(self, texts: list[str]) -> list[int]:
        sums, batch, firsts, held = [0] * len(texts), [], [], 0
        for i, t in enumerate(texts):
            for k, p in enumerate(self.pieces(t) if t else ()):
                batch.append((i, p))
                firsts.append(k == 0)
                held += len(p) if p.isascii() else len(p.encode())
                if held >= BATCH_BYTES:
                    self._lengths(batch, sums, firsts)
                    batch, firsts, held = [], [], 0
        if batch:
            self._lengths(batch, sums, firsts)
        return sums


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_column(text: Column, path: str) -> Column:
    """The number of tokens of a text under the sentencepiece model at ``path``; a null text is empty and has none."""

    def run(col: pa.Array) -> pa.Array:
        return pa.array(counter(path).count([v or "" for v in col.to_pylist()]), pa.int64())

    return arrow_scalar(run, "long")(text)


def token_counts(docs: DataFrame, path: str, *, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): a row for each row of ``docs``; repeated rows repeat.

    A null text is an empty one, of no tokens; a null id stays null. A long text is cut where no piece can cross, so its count is
    that of the whole; one that has no such place is counted in one piece. Other columns don't matter, whatever their
    names. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = columns_kept(docs, {"doc_id": id_col, "text": text_col})
    counted = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), count_column(F.col("text"), path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
