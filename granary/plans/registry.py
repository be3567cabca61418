"""Queries by name, with the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.functions.shipping import ship
from granary.plans import browsing, notations, packing, pages, records, retrieval, scripts, streams

_MODULES = (retrieval, browsing, scripts, pages, notations, records, streams, packing)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rrf_fuse_indexes(ship(spark), sf_dir)


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(ship(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _shipped(f) for m in _MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.oracle_sql().items()}
