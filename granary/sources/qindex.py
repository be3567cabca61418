"""Data sources for folders of quantised indexes and corpora: headerless little-endian files beside a manifest.

``<level>.i8`` holds codes (n x dim), ``<level>.scale.f32`` a scale a row, and optionally ``<level>.ids.i32`` ids and
``<level>.mask.u8`` a mask; ``pca.components.f32`` and ``pca.mean.f32`` project queries. Partitions are ranges of rows; each task reads
its own part of each file. Folders may lie wherever Arrow's file systems reach: a path, or an address such as ``s3://`` or
``hdfs://``.
"""

from __future__ import annotations

import contextlib
import json
import re
import sqlite3
from collections.abc import Iterator
from typing import Any
from urllib.parse import quote
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from granary.sources.files import located

_SCHEMA = "row bigint, id bigint, codes array<tinyint>, scale float, mask boolean"
ROWS = 65_536
KINDS = ("i8", "scale.f32", "ids.i32", "mask.u8")
#: What a corpus must have.
CORPUS = ("units.i8", "units.scale.f32", "units.mask.u8", "pca.components.f32", "pca.mean.f32")


class Folder:
    """Files of a folder, on any file system that Arrow knows."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _at(self, name: str) -> tuple[Any, str]:
        system, base = located(self.path)
        return system, f"{base.rstrip('/')}/{name}"

    def size(self, name: str) -> int | None:
        """The file's bytes; none if it isn't there."""
        system, at = self._at(name)
        info = system.get_file_info(at)
        return info.size if info.type == fs.FileType.File else None

    def read(self, name: str, start: int = 0, n: int | None = None) -> bytes:
        system, at = self._at(name)
        with system.open_input_file(at) as f:
            return f.read_at(f.size() - start if n is None else n, start)

    def names(self) -> list[str]:
        system, at = self._at("")
        return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(at.rstrip("/"))))

    def folders(self) -> list[str]:
        system, at = self._at("")
        return sorted(x.base_name for x in system.get_file_info(fs.FileSelector(at.rstrip("/"))) if x.type == fs.FileType.Directory)

    def make(self) -> None:
        system, at = self._at("")
        system.create_dir(at.rstrip("/"), recursive=True)

    def create(self, name: str) -> Any:
        system, at = self._at(name)
        return system.open_output_stream(at, compression=None)

    def chunks(self, name: str, n: int = 8 << 20) -> Iterator[bytes]:
        system, at = self._at(name)
        with system.open_input_stream(at, compression=None) as f:
            while chunk := f.read(n):
                yield chunk

    def remove(self) -> None:
        """The folder with all that is in it."""
        system, at = self._at("")
        if system.get_file_info(at.rstrip("/")).type == fs.FileType.Directory:
            system.delete_dir(at.rstrip("/"))

    def move_to(self, name: str, other: "Folder", to: str) -> None:
        system, at = self._at(name)
        system.move(at, other._at(to)[1])

    def manifest(self) -> dict[str, Any]:
        return json.loads(self.read("manifest.json"))


def projection(path: str) -> tuple[list[list[float]], list[float]]:
    """The components and the mean that queries are projected by."""
    folder = Folder(path)
    m = folder.manifest()
    mean = np.frombuffer(folder.read("pca.mean.f32"), "<f4")
    parts = np.frombuffer(folder.read("pca.components.f32"), "<f4")
    if len(mean) != m["embed_dim"] or len(parts) != m["embed_dim"] * m["index_dim"]:
        raise ValueError(f"{path}: the projection isn't {m['index_dim']} x {m['embed_dim']}")
    return parts.reshape(-1, len(mean)).astype(float).tolist(), mean.astype(float).tolist()


class Rows(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class Reader(DataSourceReader):
    def __init__(self, path: str, level: str, dim: int | None, rows: int, kind: str = "index") -> None:
        self.folder, self.level, self.rows = Folder(path), level, rows
        for name in CORPUS if kind == "corpus" else (f"{level}.i8", f"{level}.scale.f32"):
            if self.folder.size(name) is None:
                raise ValueError(f"{path}: {name} is missing")
        self.dim = dim = int(self.folder.manifest()["index_dim"]) if dim is None else dim
        self.n = n = self.folder.size(f"{level}.scale.f32") // 4
        if self.folder.size(f"{level}.i8") != n * dim:
            raise ValueError(f"{path}: the codes are not {n} x {dim}")
        self.has = {name: self.folder.size(f"{level}.{name}") is not None for name in ("ids.i32", "mask.u8")}

    def partitions(self) -> list[InputPartition]:
        return [Rows(i, min(i + self.rows, self.n)) for i in range(0, self.n, self.rows)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        a, n, dim = partition.start, partition.end - partition.start, self.dim

        def part(name: str, kind: str, width: int = 1) -> np.ndarray:
            size = width * np.dtype(kind).itemsize
            return np.frombuffer(self.folder.read(f"{self.level}.{name}", a * size, n * size), kind)

        row = np.arange(a, a + n)
        codes, scales = part("i8", "i1", dim), part("scale.f32", "<f4")
        ids = part("ids.i32", "<i4").astype(np.int64) if self.has["ids.i32"] else row
        mask = part("mask.u8", "u1") != 0 if self.has["mask.u8"] else np.ones(n, bool)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(codes))
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(ids), lists, pa.array(scales), pa.array(mask)], ["row", "id", "codes", "scale", "mask"])


class QuantisedIndex(DataSource):
    """``qindex``: a level of an index, or with ``kind=corpus`` a corpus, all of whose files must be there."""

    @classmethod
    def name(cls) -> str:
        return "qindex"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: object) -> Reader:
        o = self.options
        kind = o.get("kind", "index")
        return Reader(o["path"], o.get("level", "units" if kind == "corpus" else "lines"), int(o["dim"]) if "dim" in o else None, int(o.get("rows", ROWS)), kind)

    def writer(self, schema: object, overwrite: bool) -> "Writer":
        o = self.options
        return Writer(o["path"], o.get("level", "lines"), int(o["dim"]))


class Side(InputPartition):
    def __init__(self, name: str, against: str, start: int, n: int) -> None:
        self.name, self.against, self.start, self.n = name, against, start, n


class SideReader(DataSourceReader):
    """Side arrays in ranges of lines: a task reads its own part of one file."""

    def __init__(self, path: str, rows: int = ROWS) -> None:
        self.folder, self.rows = Folder(path), rows

    def partitions(self) -> list[InputPartition]:
        found = [(name, m[1], self.folder.size(name) // 4) for name in self.folder.names() if (m := re.fullmatch(r"agreement\.(.+)\.f32", name))]
        return [Side(name, against, a, min(self.rows, n - a)) for name, against, n in found for a in range(0, n, self.rows)] or [Side("", "", 0, 0)]

    def read(self, partition: Side) -> Iterator[pa.RecordBatch]:
        x = np.frombuffer(self.folder.read(partition.name, 4 * partition.start, 4 * partition.n), "<f4") if partition.name else np.zeros(0, "<f4")
        kept = np.flatnonzero(np.isfinite(x))
        yield pa.RecordBatch.from_arrays([pa.array([partition.against] * len(kept), pa.string()), pa.array(kept + partition.start), pa.array(x[kept].astype(float))], ["against", "line", "cosine"])


class Agreement(DataSource):
    """``qagreement``: (against, line, cosine) of an index's side arrays; what isn't a number is left out."""

    @classmethod
    def name(cls) -> str:
        return "qagreement"

    def schema(self) -> str:
        return "against string, line bigint, cosine double"

    def reader(self, schema: object) -> SideReader:
        return SideReader(self.options["path"], int(self.options.get("rows", ROWS)))


class Told(WriterCommitMessage):
    """What a task has written: the first of its rows, their number, and the names of its parts by kind."""

    def __init__(self, first: int, n: int, dim: int, names: dict[str, str]) -> None:
        self.first, self.n, self.dim, self.names = first, n, dim, names


class Writer(DataSourceArrowWriter):
    """Rows to parts of an index's files, a part a task, in a folder of their own. Tasks hold a range of rows each, in order; the commit looks whether
    they make 0 to n - 1 without a gap, and lists them. What fails takes the folder away, so tasks that are still at work write nothing more."""

    def __init__(self, path: str, level: str, dim: int) -> None:
        self.folder, self.level, self.dim = Folder(path), level, dim
        self.folder.make()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Told:
        task = TaskContext.get()
        names = {kind: f"{self.level}.{kind}.part-{task.partitionId():06d}-{task.taskAttemptId()}" for kind in KINDS}
        out, first, n = {}, 0, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in ("row", "id", "codes", "scale", "mask")}
            rows = column["row"].to_numpy(zero_copy_only=False)
            first = int(rows[0]) if not n else first
            if (rows != np.arange(first + n, first + n + len(rows))).any():
                raise ValueError(f"rows {first + n} and on are not in order")
            ids = column["id"].to_numpy(zero_copy_only=False)
            if ((ids < -(2**31)) | (ids >= 2**31)).any():
                raise ValueError("an id has no place in 32 bits")
            if (pc.list_value_length(column["codes"]).to_numpy(zero_copy_only=False) != self.dim).any():
                raise ValueError(f"a row has not {self.dim} codes")
            values = {"i8": column["codes"].flatten().to_numpy().astype("i1"), "scale.f32": column["scale"].to_numpy().astype("<f4"), "ids.i32": ids.astype("<i4"), "mask.u8": column["mask"].to_numpy(zero_copy_only=False).astype("u1")}
            for kind in KINDS:
                if kind not in out:
                    out[kind] = self.folder.create(names[kind])
                out[kind].write(values[kind].tobytes())
            n += len(rows)
        for f in out.values():
            f.close()
        return Told(first, n, self.dim, names if n else {})

    def commit(self, messages: list[Told | None]) -> None:
        told = sorted((m for m in messages if m is not None and m.n), key=lambda m: m.first)
        at = 0
        for m in told:
            if m.first != at:
                self.abort(messages)
                raise ValueError(f"row {at} is missing or there twice")
            at += m.n
        with self.folder.create("parts.json") as f:
            f.write(json.dumps([m.names for m in told]).encode())

    def abort(self, messages: list[Told | None]) -> None:
        self.folder.remove()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(QuantisedIndex)
    spark.dataSource.register(Agreement)
    spark.dataSource.register(CorpusTable)


def _joiner(path: str, parts_at: str, level: str) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, held = Folder(path), Folder(parts_at)
        parts = json.loads(held.read("parts.json"))
        for batch in batches:
            for kind in batch.column(0).to_pylist():
                beside = f"{kind}.joined-{TaskContext.get().taskAttemptId()}"
                n = 0
                with held.create(beside) as out:
                    for names in parts:
                        for chunk in held.chunks(names[kind]):
                            n += out.write(chunk)
                held.move_to(beside, folder, f"{level}.{kind}")
                yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([n], pa.int64())], ["kind", "bytes"])

    return run


def write(index: DataFrame, path: str, level: str = "lines", manifest: dict[str, Any] | None = None, parts: int | None = None) -> None:
    """An index's files from (row, id, codes, scale, mask). Tasks write ranges of rows as parts; then each of the files, which the format wants whole,
    is joined from its parts by a task of its own, in chunks. Nothing of it passes the driver but the parts' names."""
    spark = index.sparkSession
    register(spark)
    folder = Folder(path)
    folder.make()
    dim = (manifest or {}).get("index_dim") or (index.select(F.size("codes")).first() or [0])[0]
    ranged = index.select("row", "id", "codes", "scale", "mask").repartitionByRange(parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "row").sortWithinPartitions("row")
    parts_at = f"{path.rstrip('/')}/_parts-{uuid4().hex}"
    try:
        ranged.write.format("qindex").mode("append").option("level", level).option("dim", dim).save(parts_at)
        kinds = spark.createDataFrame([(k,) for k in KINDS], "kind string").repartition(len(KINDS), "kind")
        kinds.mapInArrow(_joiner(path, parts_at, level), "kind string, bytes long").collect()  # a row a file
    finally:
        Folder(parts_at).remove()
    with folder.create("manifest.json") as f:
        f.write(json.dumps(manifest or {}).encode())


class Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class TableReader(DataSourceReader):
    """A table of a corpus' database in ranges of its row ids; each task opens the file for itself, read only."""

    def __init__(self, path: str, database: str, table: str, rows: int) -> None:
        system, at = Folder(path)._at(database)
        if not isinstance(system, fs.LocalFileSystem):
            raise ValueError(f"{path}: a database is read from a folder that is mounted")
        self.at, self.table, self.rows = at, table, rows
        with contextlib.closing(self._open()) as db:
            self.columns = [(r[1], _SQLITE.get(r[2].upper().split("(")[0], "string")) for r in db.execute(f"PRAGMA table_info({self._name()})")]
            if not self.columns:
                raise ValueError(f"{path}: {database} has no table {table}")
            self.low, self.high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self._name()}").fetchone()

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{quote(self.at)}?mode=ro", uri=True)

    def _name(self) -> str:
        return '"' + self.table.replace('"', '""') + '"'

    def partitions(self) -> list[InputPartition]:
        return [Range(a, a + self.rows) for a in range(self.low, self.high + 1, self.rows)] if self.low is not None else [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kinds = [{"bigint": pa.int64(), "double": pa.float64()}.get(t, pa.string()) for _, t in self.columns]
        with contextlib.closing(self._open()) as db:
            found = db.execute(f"SELECT rowid, * FROM {self._name()} WHERE rowid >= ? AND rowid < ? ORDER BY rowid", (partition.low, partition.high))
            while rows := found.fetchmany(2_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), *kinds], strict=True)], ["ord", *[c for c, _ in self.columns]])


_SQLITE = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double"}


class CorpusTable(DataSource):
    """``qcorpus``: ``table`` (units, works, citations, meta) of the database of a corpus' folder, with the order of its rows as ``ord``. A column that an
    older corpus lacks isn't there; see ``catalog.optional``."""

    @classmethod
    def name(cls) -> str:
        return "qcorpus"

    def _reader(self) -> TableReader:
        o = self.options
        return TableReader(o["path"], o.get("database", "corpus.sqlite"), o.get("table", "units"), int(o.get("rows", ROWS)))

    def schema(self) -> str:
        return ", ".join(["ord bigint", *[f"`{c}` {t}" for c, t in self._reader().columns]])

    def reader(self, schema: object) -> TableReader:
        return self._reader()
