"""What the operators of this subpackage share: shipping code, cutting lineage, Arrow slices bounded by bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from granary.functions import shipping

#: Bytes of text that a kernel works on at once; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Short rows that a partition holds at least, where their number is known.
PART_ROWS = 50_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, and Arrow batches fewer rows than the default, which takes no account of long
    texts. A number of rows that was set by hand stays."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")
    return shipping.ship(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the context's checkpoint folder, else what ``spark.checkpoint.dir`` names.

    Where neither is set, one process that is driver and executor gets a folder of its own; a cluster gets an error.
    """
    sc = spark.sparkContext
    if found := sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="granary-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in :func:`shared_folder`."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """A table written in :func:`shared_folder` and read again; it goes when the application ends. Unlike :func:`cut` it brings
    none of what Spark had concluded about the rows, which in a loop grows with each turn."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString())


def sized(df: DataFrame, rows: int) -> DataFrame:
    """A table that was cut, of ``rows`` rows, in no more partitions than these need; so small tables make few small files."""
    need = max(1, -(-rows // PART_ROWS))
    return df.coalesce(need) if need < df.rdd.getNumPartitions() else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parts(spark: SparkSession) -> int:
    """Partitions for a shuffle that is asked for by name."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of a batch, each of at most ``limit`` text bytes or of one row."""
    sizes = _lengths(batch.column(batch.schema.get_field_index(column)))
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)


def give_back() -> None:
    """Give memory that Arrow and the C library keep for later back to the system: a worker serves many stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not everywhere
        pass


def _lengths(col: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    n = pc.list_value_length(col) if pa.types.is_list(col.type) else pc.binary_length(col)
    return pc.fill_null(n, 0).to_pylist()


def map_slices(df: DataFrame, column: str, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``mapInArrow`` with ``kernel`` on slices bounded by the bytes of ``column``."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in by_bytes(batch, column):
                yield kernel(piece)
            give_back()

    return df.mapInArrow(run, schema)


def arrow_scalar(kernel: Callable[..., pa.Array], return_type: str) -> Callable[..., Column]:
    """A scalar Arrow function that gives ``kernel`` slices bounded by the bytes of its first column.

    It counts as non-deterministic only so that a filter on its result doesn't evaluate it a second time.
    """

    def run(col: pa.Array, *more: pa.Array) -> pa.Array:
        names = [str(i) for i in range(1 + len(more))]
        batch = pa.RecordBatch.from_arrays([col, *more], names)
        out = [kernel(*piece.columns) for piece in by_bytes(batch, "0")]
        give_back()
        return pa.concat_arrays(out) if out else kernel(*batch.columns)

    with warnings.catch_warnings():  # the kind is named, as the number of columns is open
        warnings.simplefilter("ignore", UserWarning)
        return F.arrow_udf(run, return_type, ArrowUDFType.SCALAR).asNondeterministic()


def text_bytes(col: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; a null is empty."""
    for v in col.cast(pa.large_binary()) if pa.types.is_large_string(col.type) else col.cast(pa.binary()):
        yield v.as_py() or b""


def cut_points(b: bytes, size: int, stops: bytes) -> Iterator[bytes]:
    """Pieces of about ``size`` bytes, each but the last ending right before one of ``stops``.

    Pieces grow where no stop occurs, so that nothing is ever cut elsewhere.
    """
    at, n = 0, len(b)
    while n - at > size:
        found = [x for s in stops if (x := b.find(s, at + size)) >= 0]
        if not found:
            break
        yield b[at : (at := min(found))]
    yield b[at:]


def columns_kept(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` reduced to ``columns`` (own name -> column). They are found by place, so that other columns whose names
    differ in case only, or are those that an operator uses inside, don't matter."""
    at = {c: _place(df, c) for c in columns.values()}
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).select(*[F.col(f"_{at[c]}").alias(k) for k, c in columns.items()])


def by_place(df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """``df`` with its columns named by their places, so that names which differ in case only, or are used inside an
    operator, don't clash; and the name by place of a column. Give results the names of ``df`` again by ``toDF``."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]), lambda name: f"_{_place(df, name)}"


def _place(df: DataFrame, name: str) -> int:
    """Where the column of exactly this name is, or the only one whose name differs in case alone."""
    same = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(same) != 1:
        raise ValueError(f"{len(same)} columns are named {name}")
    return same[0]
