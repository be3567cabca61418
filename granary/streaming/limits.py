"""Per-client fixed windows that start at a client's first request: as a fold over batches, and as stream state.

A request is refused if its window is full; refused requests don't spend. A window lasts ``window_us``, from the request
that opened it. With a tight limit for some requests, the general one is looked at first, both must pass, both are spent.
Exempt requests always pass and are not counted. Requests without a client are one client.

A client's requests are settled one after the other, so one client is the work of one task, as the rule has it; its rows
stream by and are never held together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from granary.functions.text import normalize_ip, text_of


@dataclass(frozen=True)
class Rule:
    """The limits, and the step from a client's state (n, start, tight n, tight start) and a request to the next state."""

    limit: int
    window: int
    tight: int | None = None

    def step(self, state: tuple[int, int, int, int], at: int, tight: bool) -> tuple[bool, tuple[int, int, int, int]]:
        n, start, tn, tstart = state
        if not n or at - start >= self.window:
            n, start = 0, at
        if not tn or at - tstart >= self.window:
            tn, tstart = 0, at
        bound = tight and self.tight is not None and self.tight < self.limit
        ok = n < self.limit and not (bound and tn >= self.tight)
        return ok, (n + ok, start, tn + (ok and tight), tstart)


def client_key(header: Column, forwarded: Column, socket: Column, hops: int) -> Column:
    """A trusted header, else the address ``hops`` from the right of the forwarded list, else the socket's."""
    chain = F.filter(F.transform(F.split(text_of(forwarded), ","), lambda a: F.trim(a)), lambda a: a != "")
    at = F.try_element_at(chain, F.lit(-hops)) if hops else F.lit(None).cast("string")
    return normalize_ip(F.coalesce(F.nullif(F.trim(text_of(header)), F.lit("")), at, socket))


def fixed_window(requests: DataFrame, client: str, at: str, order: str, limit: int, window_us: int, tight: Column | None = None, tight_limit: int | None = None, exempt: Column | None = None) -> DataFrame:
    """(client, ord, at, allowed, remaining) for requests with times in microseconds; what is left is null if exempt."""
    rule = Rule(limit, window_us, tight_limit)
    no = F.lit(False)
    own = requests.select(F.col(client).alias("client"), F.col(order).cast("long").alias("ord"), F.col(at).cast("long").alias("at"), (no if tight is None else F.coalesce(tight, no)).alias("tight"), (no if exempt is None else F.coalesce(exempt, no)).alias("exempt"))
    dealt = own.repartition("client").sortWithinPartitions("client", "at", "ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), (0, 0, 0, 0)
        for batch in batches:
            allowed, remaining = [], []
            for c, t, is_tight, free in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if c != current:
                    current, state = c, (0, 0, 0, 0)
                if free:
                    allowed.append(True)
                    remaining.append(None)
                    continue
                ok, state = rule.step(state, t, is_tight)
                allowed.append(ok)
                remaining.append(limit - state[0])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(allowed, pa.bool_()), pa.array(remaining, pa.int64())], ["client", "ord", "at", "allowed", "remaining"])

    kind = own.schema["client"].dataType.simpleString()
    return dealt.mapInArrow(run, f"client {kind}, ord long, at long, allowed boolean, remaining long")


OUTPUT = StructType([StructField("client", StringType()), StructField("ord", LongType()), StructField("at", LongType()), StructField("allowed", BooleanType()), StructField("remaining", LongType())])
#: Clients that are remembered at most, over all buckets; and the buckets that they are dealt to.
MOST_CLIENTS, BUCKETS = 50_000, 64
_KEY = StructType([StructField("client", StringType())])
_STATE = StructType([StructField(c, LongType()) for c in ("n", "start", "tn", "tstart", "place")])
_CLOCK = StructType([StructField("at", LongType()), StructField("place", LongType())])


class Windows:
    """The windows of a bucket's clients: at most ``most``, if that is given, in the order in which they were first met.

    Where a client more is met, those whose windows are over go first; if none is, the one that was met first.
    """

    def __init__(self, rule: Rule, most: int | None, held: dict[str, tuple[int, ...]], place: int = 0) -> None:
        self.rule, self.most, self.place = rule, most, place
        self.held = dict(sorted(held.items(), key=lambda kv: kv[1][4]))

    def sweep(self, now: int) -> None:
        over = lambda v: now - v[1] >= self.rule.window and (not v[2] or now - v[3] >= self.rule.window)
        self.held = {k: v for k, v in self.held.items() if not over(v)}

    def request(self, client: str, at: int, tight: bool) -> tuple[bool, int]:
        known = self.held.get(client)
        ok, state = self.rule.step(known[:4] if known else (0, 0, 0, 0), at, tight)
        if known is None:
            if self.most is not None and len(self.held) >= self.most:
                self.sweep(at)
                if len(self.held) >= self.most:
                    del self.held[next(iter(self.held))]
            self.place += 1
        self.held[client] = (*state, known[4] if known else self.place)
        return ok, self.rule.limit - state[0]


class Limiter(StatefulProcessor):
    """The same rule on a stream, for the clients of a bucket: a map of bounded size in the state store, swept by a timer once a window.

    A bucket's rows of one micro-batch are put in order, so a trigger's size bounds what is held; of the state a worker holds
    one bucket, of at most ``most`` clients, or of all that were dealt to it. Only what changed is written back.
    """

    def __init__(self, rule: Rule, most: int | None, expire: bool = True) -> None:
        self.rule, self.most, self.expire = rule, most, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", _KEY, _STATE)
        self.clock = handle.getValueState("clock", _CLOCK)

    def _load(self) -> tuple[Windows, dict[str, tuple[int, ...]], int]:
        before = {k[0]: tuple(v) for k, v in self.windows.iterator()}
        at, place = tuple(self.clock.get()) if self.clock.exists() else (0, 0)
        return Windows(self.rule, self.most, before, place), before, at

    def _store(self, windows: Windows, before: dict[str, tuple[int, ...]], at: int) -> None:
        for k in before.keys() - windows.held.keys():
            self.windows.removeKey((k,))
        for k, v in windows.held.items():
            if before.get(k) != v:
                self.windows.updateValue((k,), v)
        self.clock.update((at, windows.place))

    def _again(self, timers) -> None:  # noqa: ANN001
        if self.expire and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + max(1, self.rule.window // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        frame = pd.concat(list(rows)).sort_values(["at", "ord"])
        windows, before, now = self._load()
        allowed, remaining = [], []
        for who, t, tight, free in zip(frame["client"].tolist(), frame["at"].tolist(), frame["tight"].tolist(), frame["free"].tolist(), strict=True):
            # a null client is one client; its name can't be another's
            ok, left = (True, None) if free else windows.request("" if who is None or who != who else f"={who}", t, bool(tight))
            allowed.append(ok)
            remaining.append(left)
        self._store(windows, before, max(now, int(frame["at"].max())))
        self._again(timerValues)
        yield frame[["client", "ord", "at"]].assign(allowed=allowed, remaining=pd.array(remaining, "Int64"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        windows, before, now = self._load()
        windows.sweep(now)
        self._store(windows, before, now)
        if windows.held:
            self._again(timerValues)
        return iter(())

    def close(self) -> None:
        pass


def limit_stream(requests: DataFrame, limit: int, window_us: int, tight: Column | None = None, tight_limit: int | None = None, exempt: Column | None = None, expire: bool = True, most: int | None = MOST_CLIENTS, buckets: int = BUCKETS, told_exempt: bool = False) -> DataFrame:
    """A stream of (client: string, ord, at) with what the limits say of each request. Exempt requests pass anyway; they come out, with a null for
    what is left, only if ``told_exempt``.

    Clients are dealt to ``buckets`` by a hash. Their state is bounded: ``most`` clients in all, an equal share a bucket; the client that
    was met first is forgotten, and so may begin a window anew. With ``most`` None none is, and ``buckets`` must grow with the clients. The sweep's timer goes by the clock of the cluster, what it takes away by the
    latest request's time. For timers Spark runs batches without data for as long as the stream lives; a query that shall end when its input does needs
    ``expire=False``, or ``noDataMicroBatches`` off.
    """
    no = F.lit(False)
    own = requests.select("client", "ord", "at", (no if tight is None else F.coalesce(tight, no)).alias("tight"), (no if exempt is None else F.coalesce(exempt, no)).alias("free"))
    own = own if told_exempt else own.filter("NOT free")
    dealt = own.withColumn("bucket", F.pmod(F.xxhash64("client"), F.lit(buckets)).cast("int"))
    limiter = Limiter(Rule(limit, window_us, tight_limit), None if most is None else max(1, most // buckets), expire)
    return dealt.groupBy("bucket").transformWithStateInPandas(limiter, OUTPUT, "Append", "ProcessingTime" if expire else "None")
