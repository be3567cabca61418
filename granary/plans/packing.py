"""Packs made of a table's rows, some of them damaged or fetched in part before, and brought to another folder."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.scan import hold
from granary.plans import tables as T
from granary.sources import packs
from granary.sources.files import located
from granary.sources.store import folder

#: Pages of a pack.
PAGES = 50


def _spoil(source: str, target: str):  # noqa: ANN202
    """Every seventh pack gets a wrong byte; of every fifth one half is there already, and of every eleventh a start that isn't its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                (src, a), (dst, b) = located(f"{source}/{name}"), located(f"{target}/{name}.part")
                n, body = int(name.removesuffix(".gz")), b"".join(packs.chunks(src, a))
                dst.create_dir(b.rpartition("/")[0], recursive=True)
                if n % 5 == 2 or n % 11 == 4:
                    with dst.open_output_stream(b, compression=None) as out:
                        out.write(body[: len(body) // 2] if n % 5 == 2 else b"not this")
                if n % 7 == 3:
                    with src.open_output_stream(a, compression=None) as out:
                        out.write(body[:-20] + bytes([body[-20] ^ 1]) + body[-19:])
            yield batch

    return run


def packs_fetched(spark: SparkSession, sf: str) -> DataFrame:
    """All pages as packs, fetched: whole, gone on with in the middle, begun anew, or damaged and left out."""
    at = f"{folder(spark)}/granary-packs/{uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    pages = T.read(spark, sf, "pages").select(F.floor(F.col("page_id") / PAGES).cast("long").alias("pack"), F.col("page_id").alias("ord"), F.col("html").alias("text"))
    manifest = hold(packs.write(pages, f"{at}/from"))
    manifest.select("name").mapInArrow(_spoil(f"{at}/from", f"{at}/to"), "name string").write.format("noop").mode("overwrite").save()
    got = hold(packs.fetch(manifest, f"{at}/from", f"{at}/to"))
    return got.select(F.regexp_extract("name", "^[0-9]+", 0).cast("long").alias("pack"), "status", (F.col("resumed_from") > 0).alias("resumed"), T.shown(F.col("unpacked_bytes")).alias("bytes"), F.coalesce("unpacked_sha256", F.lit("")).alias("sha256"))


def queries() -> dict:
    return {"packs_fetched": packs_fetched}


def oracle_sql() -> dict[str, str]:
    return {
        "packs_fetched": f"""SELECT pack, CASE WHEN bad THEN 'damaged' ELSE 'fetched' END AS status, NOT bad AND pack % 5 = 2 AS resumed, CASE WHEN bad THEN -1 ELSE bytes END::BIGINT AS bytes, CASE WHEN bad THEN '' ELSE sha256 END AS sha256
          FROM (SELECT page_id // {PAGES} AS pack, (page_id // {PAGES}) % 7 = 3 AS bad, sum(octet_length(encode(coalesce(html, '')))) AS bytes, sha256(string_agg(coalesce(html, ''), '' ORDER BY page_id)) AS sha256 FROM pages GROUP BY ALL)""",
    }
