"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: a start and a stride, both from hashes of
its name, which visit each slot once. Shards take turns; at its turn a shard claims the slot that it likes best among
those still free, until none is. Shards so own nearly equal numbers of slots, and adding or removing one moves few others'
slots. A row's slot is a hash of its key modulo the size. The table is broadcast: its size is fixed by ``SIZE`` (at
most ``MOST_SLOTS``), never by the data, and a placement costs one look-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import by_place, columns_kept, read

SIZE, MOST_SLOTS, SHARDS = 65_537, 1_000_003, 64


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = SIZE) -> list[int]:
    """For each slot the index of the shard that owns it. Names must differ; the order of names decides turns."""
    from xxhash import xxh64_intdigest

    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need names of their own")
    if not _prime(size) or not len(shards) <= size <= MOST_SLOTS:
        raise ValueError(f"the table's size must be a prime from the number of shards up to {MOST_SLOTS}")
    start = [xxh64_intdigest(s, 1) % size for s in shards]
    stride = [xxh64_intdigest(s, 2) % (size - 1) + 1 if size > 2 else 1 for s in shards]
    table, free = [-1] * size, size
    while True:
        for i, step in enumerate(stride):
            at = start[i]
            while table[at] >= 0:
                at = (at + step) % size
            table[at], start[i] = i, (at + step) % size
            free -= 1
            if not free:
                return table


def slot_of(key: Column, size: int = SIZE) -> Column:
    """The slot of a key; nulls share one slot."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(size)).cast("int")


def assign(df: DataFrame, key: str, shards: list[str], *, size: int = SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard's name of every row. Equal keys go together; no row is lost or moved.

    Null keys are one key; an empty one, and one of any length, is hashed whole. Repeated rows stay. The columns that it
    adds must have names of their own. An empty table stays empty.
    """
    taken = {c.lower() for c in df.columns}
    if {slot_col.lower(), shard_col.lower()} & taken:
        raise ValueError(f"{slot_col} or {shard_col} is a column already")
    table = lookup_table(shards, size)
    spark = df.sparkSession
    owners = spark.createDataFrame([(i, shards[x]) for i, x in enumerate(table)], "__slot int, __shard string")
    own, at = by_place(df)
    joined = own.withColumn("slot", slot_of(F.col(at(key)), size)).join(F.broadcast(owners), F.col("slot") == F.col("__slot"))
    return joined.drop("__slot").toDF(*df.columns, slot_col, shard_col)


def write_shards(df: DataFrame, path: str, key: str, shards: list[str], *, size: int = SIZE, files: int = 8) -> None:
    """Write ``df`` with a folder for each shard, of at most about ``files`` files. A hot shard is so cut by slot."""
    placed = assign(df, key, shards, size=size)
    placed.repartition("shard", F.pmod("slot", F.lit(files))).write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns_kept(read(spark, sf_dir, "documents"), {"doc_id": "doc_id"})
    return assign(docs, "doc_id", [f"shard-{i:05d}" for i in range(SHARDS)]).select("doc_id", "slot", "shard")
