"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against the windows of every text.

ASCII letters are lower-cased; words are runs of ASCII letters, digits and bytes from 0x80 up. A window is ten words of
an item in a row; an item of one to nine words is one window. The set of windows goes to the executors in blocks of at
most ``BLOCK_WINDOWS`` (window, item) pairs, so no broadcast grows with the benchmark: a larger benchmark makes more
blocks, each another look at the same words, without a shuffle of the texts. A rolling hash of the words of many texts
at once finds candidates; every one of them is compared word by word, so a collision of hashes never counts as a hit.
"""

from __future__ import annotations

from functools import lru_cache
from typing import Any
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import arrow_scalar, by_place, columns_kept, cut, map_slices, read, ship

WORDS = 10
#: (window, item) pairs in one broadcast: some 30 MB with ordinary words.
BLOCK_WINDOWS = 200_000
_CHUNK, _LONG = 1 << 20, 1 << 12
_STATE = "struct<n_words: long, hit: array<struct<a: int, b: int>>, items: array<long>>"
_STATE_ARROW = pa.struct([("n_words", pa.int64()), ("hit", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("items", pa.list_(pa.int64()))])


@lru_cache(1)
def _tables() -> tuple[np.ndarray, ...]:
    """Which bytes are in words, a number for each byte (one for both cases of a letter), and powers of an odd base."""
    b = np.arange(256)
    inside = (b >= 0x80) | ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x41) & (b <= 0x5A)) | ((b >= 0x61) & (b <= 0x7A))
    number = np.random.default_rng(1).integers(1, 2**63, 256, np.uint64)
    number[0x41:0x5B] = number[0x61:0x7B]
    base = 0x9E3779B97F4A7C15
    up = np.multiply.accumulate(np.full(_CHUNK + _LONG + 2, base, np.uint64))
    down = np.multiply.accumulate(np.full(_CHUNK + _LONG + 2, pow(base, -1, 1 << 64), np.uint64))
    return inside, number, up, down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of many texts: where each starts and ends in their joined bytes, its text, and its hash."""

    def __init__(self, col: pa.Array) -> None:
        from xxhash import xxh64_intdigest

        inside, number, up, down = _tables()
        col = col.cast(pa.binary()).fill_null(b"")
        _, offsets, data = col.buffers()
        at = np.frombuffer(offsets, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        at -= at[0]
        mask = inside[self.data]
        before, after = np.zeros_like(mask), np.zeros_like(mask)
        before[1:], after[:-1] = mask[:-1], mask[1:]
        full = at[1:] > at[:-1]
        before[at[:-1][full]] = False
        after[at[1:][full] - 1] = False
        self.start, self.end = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
        self.row = np.searchsorted(at[:-1], self.start, "right") - 1
        #: The first word of each text, and the number of words at the end.
        self.first = np.searchsorted(self.start, at)
        self.hash = np.zeros(len(self.start), np.uint64)
        lo = 0
        while lo < len(self.start):
            base = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(self.start, base + _CHUNK)))
            long = self.end[lo:hi] - self.start[lo:hi] > _LONG
            stop = int(self.end[lo:hi][~long].max(initial=base))
            sums = np.zeros(min(stop - base, _CHUNK + _LONG) + 1, np.uint64)
            np.cumsum(number[self.data[base : base + len(sums) - 1]] * up[: len(sums) - 1], out=sums[1:])
            s, e = np.where(long, 0, self.start[lo:hi] - base), np.where(long, 0, self.end[lo:hi] - base)
            self.hash[lo:hi] = _mixed((sums[e] - sums[s]) * down[s])
            for i in np.flatnonzero(long) + lo:  # rare; keeps the sums short
                self.hash[i] = xxh64_intdigest(self.data[self.start[i] : self.end[i]].tobytes().lower())
            lo = hi

    def windows(self, n: int) -> np.ndarray:
        """The hash of the ``n`` words from each word on, whatever texts they are in."""
        if len(self.hash) < n:
            return np.zeros(0, np.uint64)
        _, _, up, down = _tables()
        out = np.zeros(len(self.hash) - n + 1, np.uint64)
        for lo in range(0, len(out), _CHUNK):
            part = self.hash[lo : lo + _CHUNK + n - 1]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            k = len(part) - n + 1
            out[lo : lo + k] = _mixed((sums[n:] - sums[:k]) * down[:k])
        return out

    def text(self, i: int, n: int) -> bytes:
        data = self.data
        return b" ".join([data[s:e].tobytes().lower() for s, e in zip(self.start[i : i + n].tolist(), self.end[i : i + n].tolist(), strict=True)])


def _window_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    words, ids, texts = Words(batch.column(1)), [], []
    for item, lo, hi in zip(batch.column(0).to_pylist(), words.first[:-1], words.first[1:], strict=True):
        n = min(WORDS, int(hi - lo))
        for i in range(lo, hi - n + 1) if n else ():
            texts.append(words.text(i, n))
            ids.append(item)
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(ids, pa.int64())], ["win", "item_id"])


def benchmark_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(win, item_id): the distinct windows of every item, as the bytes of their words with spaces between."""
    rows = columns_kept(bench, {"item_id": id_col, "text": text_col}).withColumn("item_id", F.col("item_id").cast("long"))
    return map_slices(rows, "text", _window_rows, "win binary, item_id long").distinct()


class Block:
    """A bounded hash set of windows with the items that have them."""

    def __init__(self, wins: list[bytes], items: list[int | None]) -> None:
        self.items: dict[bytes, list[int | None]] = {}
        for w, i in zip(wins, items, strict=True):
            self.items.setdefault(w, []).append(i)
        self.lengths = sorted({w.count(b" ") + 1 for w in self.items})
        words = Words(pa.array(list(self.items), pa.binary()))
        hashes = {n: words.windows(n) for n in self.lengths}
        self.bits: dict[int, np.ndarray] = {}
        for n in self.lengths:
            bits = np.zeros(1 << 22, bool)
            for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
                if hi - lo == n:
                    bits[int(hashes[n][lo]) >> 42] = True
            self.bits[n] = bits

    def scan(self, col: pa.Array, state: pa.Array | None = None) -> pa.Array:
        words = Words(col)
        cover = np.zeros(len(words.start) + 1, np.int64)
        found: list[set[int | None]] = [set() for _ in range(len(col))]
        for n in self.lengths:
            h = words.windows(n)
            if not len(h):
                continue
            at = np.flatnonzero(self.bits[n][(h >> np.uint64(42)).astype(np.int64)])
            for i in at[words.row[at] == words.row[at + n - 1]].tolist():
                if (items := self.items.get(words.text(i, n))) is not None:
                    found[words.row[i]].update(items)
                    cover[i] += 1
                    cover[i + n] -= 1
        if state is not None:
            for r, x in enumerate(state.to_pylist()):
                found[r].update(x["items"])
                for span in x["hit"]:
                    cover[words.first[r] + span["a"]] += 1
                    cover[words.first[r] + span["b"]] -= 1
        hit = np.cumsum(cover)[:-1] > 0
        out = []
        for r, (lo, hi) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            spans: list[dict[str, int]] = []
            if found[r]:
                edge = np.flatnonzero(np.diff(np.concatenate(([False], hit[lo:hi], [False])).astype(np.int8)))
                spans = [{"a": a, "b": b} for a, b in edge.reshape(-1, 2).tolist()]
            out.append({"n_words": hi - lo, "hit": spans, "items": list(found[r])})
        return pa.array(out, _STATE_ARROW)


def scan(docs: DataFrame, bench: DataFrame, *, text_col: str = "text", out_col: str = "contamination", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with a struct ``out_col``: n_words, hit (word spans, end excluded, merged), items (unordered).

    A null text has no words. Items that are null or have no words have no window; the windows of an item without an
    id hit, and stand as a null in ``items``. Repeated items count once. An empty benchmark hits nothing. Texts are scanned whole,
    however long; repeated documents repeat; an empty table stays empty. Own columns may have any names but that of
    ``out_col``, which is an error.
    """
    if out_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"{out_col} is a column already")
    ship(docs.sparkSession)
    own, at = by_place(docs)
    wins = benchmark_windows(bench, item_id, item_text)
    rows, n = wins.limit(block + 1).toArrow(), 1
    if rows.num_rows > block:
        wins = cut(wins)
        n = -(-wins.count() // block)
    for k in range(n):
        rows = wins.filter(F.pmod(F.xxhash64("win", "item_id"), F.lit(n)) == k).toArrow() if n > 1 else rows
        sent: Any = docs.sparkSession.sparkContext.broadcast((uuid4().hex, rows.column("win").to_pylist(), rows.column("item_id").to_pylist()))
        look = arrow_scalar(_scanner(sent), _STATE)
        col = F.col(at(text_col))
        own = own.withColumn("state", look(col, F.col("state")) if k else look(col))
    return own.toDF(*docs.columns, out_col)


_HELD: dict[str, Block] = {}


def _scanner(sent: Any) -> Any:
    def run(col: pa.Array, state: pa.Array | None = None) -> pa.Array:
        name, *wins = sent.value
        block = _HELD.get(name)
        if block is None:
            _HELD.clear()
            block = _HELD[name] = Block(*wins)
        return block.scan(col, state)

    return run


def decontaminate(docs: DataFrame, bench: DataFrame, *, text_col: str = "text", remove: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the hit words cut out of their texts.

    A cut span runs from the first byte of its first word to the last byte of its last. All columns stay, and so do rows
    with a null or empty text; repeated rows stay or go together.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    own, at = by_place(docs)
    text = at(text_col)
    found = scan(own, bench, text_col=text, out_col="found")
    hit = F.size(F.col("found.hit")) > 0
    if remove == "spans":
        cutter = arrow_scalar(_without, "string")
        found = found.withColumn(text, F.when(hit, cutter(F.col(text), F.col("found.hit"))).otherwise(F.col(text)))
    else:
        found = found.filter(~hit)
    return found.drop("found").toDF(*docs.columns)


def _without(col: pa.Array, hits: pa.Array) -> pa.Array:
    words, out, at = Words(col), [], 0
    for r, (v, spans) in enumerate(zip(col, hits.to_pylist(), strict=True)):
        b = (v.as_py() or "").encode()
        kept, pos, lo = [], 0, words.first[r]
        for span in spans or ():
            kept.append(b[pos : words.start[lo + span["a"]] - at])
            pos = words.end[lo + span["b"] - 1] - at
        out.append(b"".join([*kept, b[pos:]]))
        at += len(b)
    return pa.array(out, pa.binary()).cast(pa.string())


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns_kept(read(spark, sf_dir, "documents"), {"doc_id": "doc_id", "text": "text"})
    x = "contamination"
    items = F.array_sort(F.transform(F.filter(f"{x}.items", lambda i: i.isNotNull()), lambda i: i.cast("string")))
    found = scan(docs, read(spark, sf_dir, "benchmark"), out_col=x).select("doc_id", x)
    n_hit = F.aggregate(f"{x}.hit", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select("doc_id", F.col(f"{x}.n_words").alias("n_words"), n_hit.alias("n_hit"), items.alias("ids")).select(
        "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
