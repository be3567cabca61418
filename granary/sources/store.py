"""Tables that are made once from others and kept: the first query that needs one writes it, all others read it.

A kept table lies in a folder that driver and executors share, under a name made from its own, its version, and the place,
length and time of every file it was made from, those in folders below included; so an input that changes or grows is never
met with an older table. It is written beside its place and moved there, so half a table is never read. Tables that a newer one
takes the place of go once they are older than a day, as a query may still read them.
"""

from __future__ import annotations

import hashlib
import tempfile
import time
from collections.abc import Callable, Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SETTING = "spark.granary.store"
#: Seconds for which a table stays that a newer one takes the place of.
GRACE = 86_400
#: Schemas of tables that this process has read; a second read needs no look into their files.
_SCHEMAS: dict[str, StructType] = {}


def folder(spark: SparkSession) -> str:
    """What the setting names, else the checkpoint folder. Where neither is set, one process has a folder of its own, which
    goes with it; a cluster gets an error, as its machines share no folder that could be guessed."""
    sc = spark.sparkContext
    found = spark.conf.get(SETTING, None) or sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError(f"{SETTING} and spark.checkpoint.dir are not set; one must name a folder that driver and executors share")
    if not getattr(sc, "_granary_store", None):
        sc._granary_store = tempfile.mkdtemp(prefix="granary-store-")
        path = spark._jvm.org.apache.hadoop.fs.Path(sc._granary_store)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return sc._granary_store


def state(spark: SparkSession, source: str) -> tuple[object, ...]:
    """What tells a file or a folder from what it was before. A folder's files are listed by Spark, however deep and many they are, and told by a
    sum over all paths, lengths and times; only that sum comes to the driver."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    if status.isFile():
        return status.getLen(), status.getModificationTime()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path", "length", F.unix_micros("modificationTime").alias("at"))
    lanes = [F.bit_xor(F.xxhash64(F.lit(k), "path", "length", "at")) for k in range(2)]
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), *lanes).first())


def kept(spark: SparkSession, name: str, version: int, sources: Sequence[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name``, made by ``build`` from the files or folders ``sources`` if it isn't there yet."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    short = lambda x: hashlib.sha256(repr(x).encode()).hexdigest()[:16]
    where = [place(s).getFileSystem(conf).makeQualified(place(s)).toString() for s in sources]
    own = f"{folder(spark)}/granary-store/{name}-{short(where)}"
    at = f"{own}-{short((version, [state(spark, s) for s in sources]))}"
    if at in _SCHEMAS:
        return spark.read.schema(_SCHEMAS[at]).parquet(at)
    files = place(at).getFileSystem(conf)
    if not files.exists(place(at)):
        beside = f"{at}-{uuid4().hex}"
        build().write.parquet(beside)
        if not files.rename(place(beside), place(at)) or files.exists(place(f"{at}/{place(beside).getName()}")):
            files.delete(place(f"{at}/{place(beside).getName()}"), True)  # another was first
            files.delete(place(beside), True)
        for old in files.globStatus(place(f"{own}-*")) or []:
            if old.getPath().getName() != place(at).getName() and old.getModificationTime() < 1000 * (time.time() - GRACE):
                files.delete(old.getPath(), True)
    found = spark.read.parquet(at)
    _SCHEMAS[at] = found.schema
    return found
