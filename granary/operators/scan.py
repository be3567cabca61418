"""Running counts and sums within groups that may be larger than a task.

Rows are dealt by ranges of (group, order), so a group that holds most rows lies in many partitions. Each partition tells
its first and last group and what it holds of the last: one row a partition, all that ever meets on the driver. From
these follows what each partition's first group brings along, and a second pass adds it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from granary.sources.store import folder


def in_ranges(rows: DataFrame, parts: int, key: str, order: Sequence[Column | str], cut: Sequence[Column | str] | None = None) -> DataFrame:
    """``rows`` in ranges of (key, order), sorted within each. ``cut`` are shorter sort keys of the same order for the bounds
    of ranges, where ``order`` holds long values."""
    return rows.repartitionByRange(parts, key, *(order if cut is None else cut)).sortWithinPartitions(key, *order)


def hold(rows: DataFrame) -> DataFrame:
    """``rows`` as a checkpoint, partition by partition, in the folder of kept tables where no other is set."""
    sc = rows.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder(rows.sparkSession))
    return rows.checkpoint()


def _runs(column: pa.Array) -> np.ndarray:
    """Where the runs of equal values start; nulls equal each other."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _long(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def running(held: DataFrame, key: str, sums: Sequence[str] = (), rank: str = "rank", prefix: str = "running_") -> DataFrame:
    """``held`` with each row's place in its group, from 0, and the sums of columns up to and with it.

    ``held`` is what :func:`in_ranges` gives, stored (a checkpoint or a written table that is read file by file), so that both
    passes meet the same partitions in the same order. Groups of one row, null keys and empty partitions are groups and
    partitions like others; nulls count as 0 in sums.
    """
    kind = held.schema[key].dataType

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        n, totals, seen, several = 0, [0] * len(sums), False, False
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(b.schema.get_field_index(key))
            at = int(_runs(keys)[-1])
            if not seen:
                first, seen = keys[0:1], True
            elif keys[0].as_py() != last[0].as_py():
                several, n, totals = True, 0, [0] * len(sums)
            if at:
                several, n, totals = True, 0, [0] * len(sums)
            last = keys[len(keys) - 1 :]
            n += b.num_rows - at
            totals = [t + int(_long(b, s)[at:].sum()) for t, s in zip(totals, sums, strict=True)]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([_partition()], pa.int32()), first, last, pa.array([several]), pa.array([n], pa.int64()), pa.array([totals], pa.list_(pa.int64()))], ["part", "first", "last", "several", "n", "totals"])

    told_schema = StructType.fromDDL("part int, several boolean, n long, totals array<long>")
    told_schema = StructType([told_schema[0], StructField("first", kind), StructField("last", kind), *told_schema[1:]])
    told = sorted(held.mapInArrow(ends, told_schema).collect(), key=lambda r: r["part"])
    brought: dict[int, tuple[int, list[int]]] = {}
    state: tuple[Any, int, list[int]] | None = None
    for r in told:
        goes_on = state is not None and state[0] == r["first"]
        if goes_on:
            brought[r["part"]] = (state[1], state[2])
        if goes_on and not r["several"]:
            state = (state[0], state[1] + r["n"], [a + b for a, b in zip(state[2], r["totals"], strict=True)])
        else:
            state = (r["last"], r["n"], list(r["totals"]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, (n, totals) = None, brought.get(_partition(), (0, [0] * len(sums)))
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(b.schema.get_field_index(key))
            if last is not None and keys[0].as_py() != last:
                n, totals = 0, [0] * len(sums)
            starts = _runs(keys)
            sizes = np.diff(np.append(starts, len(keys)))
            place = np.arange(len(keys)) - np.repeat(starts, sizes)
            place[: sizes[0]] += n
            out, after = [pa.array(place)], []
            for s, brought_along in zip(sums, totals, strict=True):
                c = np.cumsum(_long(b, s))
                own = c - np.repeat(c[starts] - _long(b, s)[starts], sizes)
                own[: sizes[0]] += brought_along
                out.append(pa.array(own))
                after.append(int(own[-1]))
            last, n, totals = keys[len(keys) - 1].as_py(), int(place[-1]) + 1, after
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, rank, *[prefix + s for s in sums]])

    more = [StructField(c, LongType()) for c in (rank, *[prefix + s for s in sums])]
    return held.mapInArrow(add, StructType([*held.schema.fields, *more]))


def filled(held: DataFrame, key: str, column: str, name: str) -> DataFrame:
    """``held`` with ``name``: of each group's rows up to and with each one, the last value of ``column`` that isn't null; null where none
    is. ``held`` is stored and in ranges, as for :func:`running`; what a partition brings along is one value."""
    key_kind, kind = held.schema[key].dataType, held.schema[column].dataType

    def last_in(values: pa.Array, start: int) -> pa.Scalar | None:
        at = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False)[start:])
        return values[start + int(at[-1])] if len(at) else None

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = value = None
        seen, several = False, False
        for b in batches:
            if not b.num_rows:
                continue
            keys, values = (b.column(b.schema.get_field_index(c)) for c in (key, column))
            at = int(_runs(keys)[-1])
            if not seen:
                first, seen = keys[0:1], True
            elif keys[0].as_py() != last[0].as_py():
                several, value = True, None
            if at:
                several, value = True, None
            last = keys[len(keys) - 1 :]
            value = last_in(values, at) or value
            typed = values.type
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([_partition()], pa.int32()), first, last, pa.array([several]), pa.array([value.as_py() if value is not None else None], typed)], ["part", "first", "last", "several", "value"])

    part, several = StructType.fromDDL("part int, several boolean")
    told = sorted(held.mapInArrow(ends, StructType([part, StructField("first", key_kind), StructField("last", key_kind), several, StructField("value", kind)])).collect(), key=lambda r: r["part"])
    brought: dict[int, Any] = {}
    state: tuple[Any, Any] | None = None
    for r in told:
        goes_on = state is not None and state[0] == r["first"]
        if goes_on:
            brought[r["part"]] = state[1]
        alone = goes_on and not r["several"] and r["value"] is None
        state = (r["last"], state[1] if alone else r["value"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, value = None, brought.get(_partition())
        for b in batches:
            if not b.num_rows:
                continue
            keys, values = (b.column(b.schema.get_field_index(c)) for c in (key, column))
            if last is not None and keys[0].as_py() != last[0]:
                value = None
            starts = _runs(keys)
            begin = np.repeat(starts, np.diff(np.append(starts, len(keys))))
            at = np.maximum.accumulate(np.where(values.is_valid().to_numpy(zero_copy_only=False), np.arange(len(keys)), -1))
            out = values.take(pa.array(np.where(at >= begin, at, 0), mask=at < begin))
            head = int((at[: len(begin)] < 0).sum()) if begin[0] == 0 else 0
            head = min(head, int(starts[1]) if len(starts) > 1 else len(keys))
            if value is not None and head:
                out = pa.concat_arrays([pa.array([value] * head, values.type), out.slice(head)])
            last, value = (keys[len(keys) - 1].as_py(),), out[len(out) - 1].as_py()
            yield pa.RecordBatch.from_arrays([*b.columns, out], [*b.schema.names, name])

    return held.mapInArrow(add, StructType([*held.schema.fields, StructField(name, kind)]))


def joined(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The inner join of rows and their groups, of which one may hold most rows. ``size`` is a column of ``groups``: the
    rows of each, of ``total`` in all. Groups of more than a 2,000th of the rows, at most 2,000 of them, are broadcast; for
    the others' join no key has more. ``keep`` may store the groups, which are read twice."""
    groups = keep(groups) if keep else groups
    limit = max(1_000, total // 2_000)
    hot = groups.filter(F.col(size) > limit)
    inside = [c for c in groups.columns if c not in keys]
    marked = rows.join(F.broadcast(hot.select(*keys, F.struct(*inside).alias("__hot"))), keys, "left")
    done = marked.filter("__hot IS NOT NULL").select(*rows.columns, *[F.col("__hot")[c].alias(c) for c in inside])
    rest = marked.filter("__hot IS NULL").select(*rows.columns).join(groups.filter(F.col(size) <= limit), keys)
    return done.unionByName(rest.select(*rows.columns, *inside))
