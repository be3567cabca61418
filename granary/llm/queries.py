"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm.audit import OP13_SQL, op13_filter_audit
from granary.llm.bpe import op2_bpe
from granary.llm.chat import OP8_SQL, op8_chat
from granary.llm.decontaminate import op1_decontaminate
from granary.llm.pii import op10_pii
from granary.llm.quality import op5_quality
from granary.llm.sharding import op6_sharding
from granary.llm.simhash import op9_simhash
from granary.llm.token_counts import op3_token_counts
from granary.llm.topk import OP7_SQL, op7_topk
from granary.llm.toxicity import op4_toxicity
from granary.llm.trie import OP12_SQL, op12_prefix_trie
from granary.llm.warc import OP11_SQL, op11_warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_decontaminate, op2_bpe, op3_token_counts, op4_toxicity, op5_quality, op6_sharding, op7_topk, op8_chat, op9_simhash, op10_pii, op11_warc, op12_prefix_trie, op13_filter_audit, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op7_topk": OP7_SQL, "op8_chat": OP8_SQL, "op11_warc": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_filter_audit": OP13_SQL}
