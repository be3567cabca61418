"""Packs of data files: which packs a pack needs, packs written from rows, brought from folder to folder with their digests looked at,
and whether files are what their list says. Nothing is downloaded from the network."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.scan import hold
from granary.sources.files import located


def required(packs: DataFrame, needs: DataFrame) -> DataFrame:
    """(pack) of the packs asked for and all that they need, by (pack, needs), each once.

    A round a level of needs, and each looks only at packs that no round before has met; so a pack that many need is followed
    once, and circles end.
    """
    needs = hold(needs.select("pack", "needs").repartition("pack"))
    new = hold(packs.select("pack").distinct())
    met = new
    while not new.isEmpty():
        named = new.join(needs, "pack").select(F.col("needs").alias("pack")).distinct()
        new = hold(named.join(met.select(F.col("pack").alias("__met")), F.col("pack").eqNullSafe(F.col("__met")), "left_anti"))
        met = hold(met.unionByName(new))
    return met


def verified(spark: SparkSession, folder: str, listed: DataFrame) -> DataFrame:
    """(name, state) for a list of (name, sha256, bytes): ok, missing, size or digest. Files lie wherever Spark reads."""
    files = spark.read.format("binaryFile").load(folder)
    own = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("__length"), F.sha2("content", 256).alias("__sha"))
    state = F.when(F.col("__length").isNull(), "missing").when(F.col("__length") != F.col("bytes"), "size").when(F.col("__sha") != F.lower("sha256"), "digest").otherwise("ok")
    return listed.join(own, "name", "left").select("name", state.alias("state"))


#: Bytes that a task holds of a file at once.
CHUNK = 1 << 20
_MANIFEST = "name string, bytes long, sha256 string, unpacked_bytes long, unpacked_sha256 string"
_FETCHED = "name string, status string, resumed_from long, unpacked_bytes long, unpacked_sha256 string"


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = located(folder)
        system.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        pack, out = None, None

        def close() -> tuple:
            data = squeeze.flush()
            out.write(data)
            out.close()
            packed.update(data)
            system.move(f"{base}/{pack}.writing-{attempt}", f"{base}/{pack}.gz")
            return f"{pack}.gz", sizes[0] + len(data), packed.hexdigest(), sizes[1], plain.hexdigest()

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != pack:
                    if out is not None:
                        yield _rows([close()], _MANIFEST)
                    pack, out, squeeze = name, system.open_output_stream(f"{base}/{name}.writing-{attempt}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                    packed, plain, sizes = hashlib.sha256(), hashlib.sha256(), [0, 0]
                raw = (text or "").encode()
                data = squeeze.compress(raw)
                out.write(data)
                packed.update(data)
                plain.update(raw)
                sizes = [sizes[0] + len(data), sizes[1] + len(raw)]
        if out is not None:
            yield _rows([close()], _MANIFEST)

    return run


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Packs of ``rows`` (pack, ord, text): a gzip file of each pack's texts in their order, and the manifest's row of it. A pack is one
    stream, of which a task holds a text at a time."""
    dealt = rows.select(F.col("pack").cast("string").alias("pack"), "ord", "text").repartition("pack").sortWithinPartitions("pack", "ord").select("pack", "text")
    return dealt.mapInArrow(_writer(folder), _MANIFEST)


def chunks(system: Any, path: str, start: int = 0) -> Iterator[bytes]:
    with system.open_input_file(path) as f:
        at = start
        while data := f.read_at(CHUNK, at):
            at += len(data)
            yield data


def unpacked(parts: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of gzip members, a chunk at a time however far they expand. Raises ``zlib.error`` where they are damaged or end too soon."""
    d = zlib.decompressobj(31)
    begun = False
    for part in parts:
        while part:
            if d.eof:
                d = zlib.decompressobj(31)
            begun = True
            data = d.decompress(part, CHUNK)
            if data:
                yield data
            part = d.unused_data if d.eof else d.unconsumed_tail
        while not d.eof and (data := d.decompress(d.unconsumed_tail, CHUNK)):
            yield data
    if begun and not d.eof:
        raise zlib.error("the file ends too soon")


def _size(system: Any, path: str) -> int | None:
    info = system.get_file_info(path)
    return info.size if info.type == fs.FileType.File else None


def fetch_one(source: str, target: str, name: str, sha256: str, unpacked_sha256: str | None, attempt: int = 0) -> tuple[str, int, int | None, str | None]:
    """(status, resumed_from, unpacked bytes, their digest) of a file that is brought from one folder to another and unpacked there.

    What an earlier try has left, ``<name>.part``, is gone on from; if the digest of the whole is wrong then, it is fetched once more from the
    start. The digest is looked at before unpacking and after it; only what passes both gets its name. ``there``: it was there already; ``fetched``;
    ``missing``; ``damaged``, of which nothing is kept.
    """
    (src, a), (dst, b) = located(f"{source}/{name}"), located(f"{target}/{name}")
    part, final = f"{b}.part", b.removesuffix(".gz")
    if unpacked_sha256 and _size(dst, final) is not None:
        digest = hashlib.sha256()
        for data in chunks(dst, final):
            digest.update(data)
        if digest.hexdigest() == unpacked_sha256:
            return "there", 0, _size(dst, final), unpacked_sha256
    if (whole := _size(src, a)) is None:
        return "missing", 0, None, None
    resumed = 0
    for again in (False, True):
        have = 0 if again else _size(dst, part) or 0
        if have > whole:
            have = 0
        digest = hashlib.sha256()
        if have:
            for data in chunks(dst, part):
                digest.update(data)
        resumed = 0 if again else have
        with (dst.open_append_stream if have else dst.open_output_stream)(part, compression=None) as out:
            for data in chunks(src, a, have):
                out.write(data)
                digest.update(data)
        if digest.hexdigest() == sha256:
            break
        dst.delete_file(part)
    else:
        return "damaged", 0, None, None
    beside, digest, n = f"{b}.unpacking-{attempt}", hashlib.sha256(), 0
    try:
        with dst.open_output_stream(beside, compression=None) as out:
            for data in unpacked(chunks(dst, part)) if name.endswith(".gz") else chunks(dst, part):
                out.write(data)
                digest.update(data)
                n += len(data)
        if unpacked_sha256 and digest.hexdigest() != unpacked_sha256:
            raise zlib.error("what is in it is not what it should be")
    except zlib.error:
        dst.delete_file(beside)
        dst.delete_file(part)
        return "damaged", 0, None, None
    dst.move(beside, final)
    dst.delete_file(part)
    return "fetched", resumed, n, digest.hexdigest()


def fetch(manifest: DataFrame, source: str, target: str) -> DataFrame:
    """(name, status, resumed_from, unpacked_bytes, unpacked_sha256) of each of a manifest's files (name, sha256, unpacked_sha256), brought from ``source`` to
    ``target`` by tasks, a file a task, a chunk at a time. A task that is run again goes on where the first one ended. The result is written to be read once: its
    work is done whenever it is evaluated, and a second time finds all files there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = located(target)
        system.create_dir(at, recursive=True)
        for batch in batches:
            for name, sha256, inner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _rows([(name, *fetch_one(source, target, name, sha256, inner, TaskContext.get().taskAttemptId()))], _FETCHED)

    return manifest.select("name", "sha256", "unpacked_sha256").repartition("name").mapInArrow(run, _FETCHED)
