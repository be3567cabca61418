r"""WARC archives: written by tasks, read in parts.

Each record is a gzip member of its own. A reader's task gets a range of bytes of a file, looks for the three bytes that gzip
members start with, and tells a member from chance by decoding its start: it must be a WARC record's headers. It owns the
records that start inside its range, follows the last one beyond the end of the range, and goes on member by member; after a
damaged one it looks for the next start again. So a file is read by as many tasks as it has ranges, each record once.

Of records with equal payloads the one with the largest page_id is a response, the others are revisits of it that hold
its headers alone. Equal payloads are found by digest, combined before the shuffle; the pages are dealt by (digest, page_id)
to the archives, so copies of one payload, however many, spread over all of them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import Any
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import columns_kept, cut, parts, read, shared_folder, ship
from granary.operators.scan import joined
from granary.sources.files import located, under

LEAST_BYTES = 1000
SPLIT, ARCHIVE, CHUNK = 8 << 20, 1 << 30, 1 << 20
MAGIC = b"\x1f\x8b\x08"
#: Headers of a record that are longer than this are no headers.
MOST_HEAD = 1 << 20
_PRINTABLE = "".join(map(chr, range(33, 127)))
_DATE = "2000-01-01T00:00:00Z"


def record(kind: str, name: str, uri: str, payload: bytes, digest: str, refers: str | None, level: int = 6) -> bytes:
    """A gzip member: a response with its payload, or a revisit without. ``digest`` is the payload's SHA-1 in hex."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {quote(uri, safe=_PRINTABLE)}"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", level, mtime=0)


def _info() -> bytes:
    body = b"software: granary\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {_DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n", mtime=0)


class Bytes:
    """A file's bytes from a place on, a chunk at a time."""

    def __init__(self, f: Any, size: int, at: int) -> None:
        self.f, self.size, self.at, self.held = f, size, at, b""

    def more(self) -> bool:
        n = min(CHUNK, self.size - self.at - len(self.held))
        if n <= 0:
            return False
        got = self.f.read_at(n, self.at + len(self.held))
        if not got:  # the file is shorter than was told
            self.size = self.at + len(self.held)
        self.held += got
        return bool(got)

    def skip(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n


def headers(text: bytes) -> dict[str, str] | None:
    """The fields of a record's head, by lower-case name; none if it isn't one."""
    first, _, rest = text.partition(b"\r\n")
    if not re.fullmatch(rb"WARC/\d+\.\d+", first):
        return None
    fields = {}
    for line in rest.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return fields if {"warc-type", "warc-record-id"} <= fields.keys() and re.fullmatch(r"\d+", fields.get("content-length", "")) else None


def member(source: Bytes, whole: bool) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and length of the gzip member at the source's place; none if there is none or it is damaged. Without ``whole``
    only the headers are decoded. The source isn't moved."""
    unpack, out, fed = zlib.decompressobj(31), bytearray(), 0
    fields, start, need = None, 0, 0
    while True:
        if fed == len(source.held) and not source.more():
            return None  # it ends too soon
        piece = source.held[fed : fed + 65_536]
        fed += len(piece)
        try:
            out += unpack.decompress(piece)
        except zlib.error:
            return None
        if fields is None:
            if not out.startswith(b"WARC/"[: len(out)]):
                return None
            end = out.find(b"\r\n\r\n")
            if end >= 0:
                fields = headers(bytes(out[:end]))
                if fields is None:
                    return None
                if not whole:
                    return fields, b"", 0
                start, need = end + 4, int(fields["content-length"])
            elif len(out) > MOST_HEAD or unpack.eof:
                return None
        if unpack.eof:
            return (fields, bytes(out[start : start + need]), fed - len(unpack.unused_data)) if len(out) - start >= need else None


def records(f: Any, size: int, a: int, b: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records that start in [a, b)."""
    source, known = Bytes(f, size, a), a == 0
    while source.at < b:
        if not known:
            at = source.held.find(MAGIC, 0, b - source.at + len(MAGIC) - 1)
            if at < 0:
                keep = min(len(source.held), len(MAGIC) - 1)
                source.skip(len(source.held) - keep)
                if source.at >= b or not source.more():
                    return
                continue
            source.skip(at)
            if source.at >= b:
                return
            if member(source, whole=False) is None:
                source.skip(1)
                continue
        found = member(source, whole=True)
        if found is None:  # damaged; a start may lie inside
            if not source.held and not source.more():
                return
            source.skip(1)
            known = False
            continue
        yield source.at, found[0], found[1]
        source.skip(found[2])
        known = True


_READ = "path string, offset long, type string, record_id string, uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _payload(fields: dict[str, str], block: bytes) -> tuple[bytes | None, int]:
    """A response's payload and its length; of a revisit the length that its headers name."""
    if not fields.get("content-type", "").startswith("application/http"):
        return block, len(block)
    head, _, body = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
    if fields["warc-type"] == "revisit":
        return None, int(said[1]) if said else 0
    return body, len(body)


def read_archives(spark: SparkSession, files: DataFrame, *, split: int = SPLIT) -> DataFrame:
    """(path, offset, type, record_id, uri, refers_to, payload_digest, payload_bytes, payload) of every record.

    ``files`` has path and bytes. Ranges of ``split`` bytes are dealt to tasks; a record of any length is followed to its end. A
    payload's digest is that of the bytes that were read, of a revisit the one that it names. Damaged members are left out, what comes after
    them is read. Empty files and an empty table of files give no rows. A gzip member of a record inside a payload that isn't
    compressed itself would be taken for a record only where a range starts inside that payload.
    """
    ship(spark)
    at = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))
    ranges = files.select("path", F.col("bytes").cast("long").alias("bytes")).filter("bytes > 0").select("path", "bytes", F.explode(at).alias("start"))
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, place = located(path)
                with system.open_input_file(place) as f:
                    for offset, fields, block in records(f, size, start, min(size, start + split)):
                        payload, n = _payload(fields, block)
                        named = fields.get("warc-payload-digest", "").partition(":")[2]
                        digest = hashlib.sha1(payload).hexdigest() if payload is not None else base64.b32decode(named).hex() if named else None
                        bare = lambda x: x.strip("<>") if x is not None else None
                        rows.append((path, offset, fields["warc-type"], bare(fields["warc-record-id"]), fields.get("warc-target-uri"), bare(fields.get("warc-refers-to")), digest, n, payload))
                        held += len(block)
                        if held > CHUNK or len(rows) >= 1000:
                            yield out()
                            rows, held = [], 0
        if rows:
            yield out()

    return ranges.repartition(max(parts(spark), 1), "path", "start").mapInArrow(run, _READ)


def archives_in(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of the archives below a folder."""
    return spark.createDataFrame(under(path, r"\.warc\.gz$"), "path string, bytes long")


_WROTE = "path string, bytes long, records long"


def _name(page_id: int | None, copy: int = 0) -> str:
    return f"urn:page:{'' if page_id is None else page_id}" + (f"#{copy}" if copy else "")


def _writer(folder: str, archive: int) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, base = located(folder)
        system.create_dir(base, recursive=True)
        out, done, number, written, count, last, copy = None, [], 0, 0, 0, None, 0
        for batch in batches:
            for page_id, url, payload, digest, sha1, head, several in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                copy = copy + 1 if (digest, page_id) == last else 0
                last = (digest, page_id)
                again = several and (copy > 0 or page_id != head)
                if out is None or written >= archive:
                    if out is not None:
                        out.close()
                        done.append((name, written, count))
                    name = f"{folder}/{task.partitionId():05d}-{number:03d}-{task.taskAttemptId()}.warc.gz"
                    out, number, written, count = system.open_output_stream(located(name)[1], compression=None), number + 1, 0, 0
                    written += out.write(_info())
                kind = "revisit" if again else "response"
                written += out.write(record(kind, _name(page_id, copy), url, payload, sha1, _name(head) if again else None))
                count += 1
        if out is not None:
            out.close()
            done.append((name, written, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "bytes", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, *, least: int = LEAST_BYTES, archive: int = ARCHIVE) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) in a folder that all executors reach; (path, bytes, records) of each.

    A null html is empty, a null url too. Of equal payloads of ``least`` bytes or more the record of the largest page_id is a
    response, null being the smallest; of rows that repeat a page_id and a payload, one. The others are revisits. Payloads
    are compared whole by SHA-256. Other columns don't matter, whatever their names; an empty table gives no archive.

    A task's files have names of its attempt, and only those of tasks that succeeded are told, so a task that is run
    again leaves files that no one reads.
    """
    spark = ship(pages.sparkSession)
    own = columns_kept(pages, {c: c for c in ("page_id", "url", "html")})
    payload = F.coalesce("html", F.lit("")).cast("binary")
    full = own.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "key": F.coalesce(F.col("page_id").cast("string"), F.lit(""))})
    thin = cut(full.groupBy("digest", "key", "page_id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.length("payload")).alias("size")))
    groups = thin.groupBy("digest").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("ids"), ((F.sum("rows") > 1) & (F.max("size") >= least)).alias("several"))
    marks = joined(thin.select("digest", "key"), groups, ["digest"], "ids", thin.count(), cut).select("digest", "key", "head", "several")
    n = parts(spark)
    # both sides are dealt alike by hand, so that the join adds no exchange and rows of one key stay side by side
    dealt = full.repartition(n, "digest", "key").join(marks.repartition(n, "digest", "key").hint("merge"), ["digest", "key"])
    rows = dealt.select("page_id", "url", "payload", "digest", F.sha1("payload").alias("sha1"), "head", "several")
    return cut(rows.mapInArrow(_writer(folder, archive), _WROTE))


def page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^urn:page:(-?\d+)", 1)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    files = write_archives(read(spark, sf_dir, "pages"), path.toString())
    found = read_archives(spark, files).filter(F.col("type").isin("response", "revisit"))
    number = lambda c: F.nullif(page_of(F.col(c)), F.lit("")).cast("long")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", number("refers_to")).alias("refers_to"))


OP11_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), sized AS (
  SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest,
    row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST) AS place,
    max(page_id) OVER (PARTITION BY payload) AS head FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND place > 1 THEN head END AS refers_to
FROM sized
"""
