r"""Chat formatting with offset-aligned loss masks.

A turn is rendered as ``### role: text </turn>`` and a line break. In texts and roles a backslash goes before every
backslash, ``###`` and ``</turn>`` (in roles before a colon too), so a text can't end its turn or start another, and
what was written can be read back. A conversation is one stream of its turns in order, encoded once with offsets: the
loss mask marks the tokens whose spans meet a span of an assistant's text, found by binary search in the sorted spans.

One key may hold a large share of all rows, so turns are not collected: they are sorted by (conversation, turn) within
partitions and streamed into segments of whole turns of about ``SEGMENT_CHARS``. That pass only writes the template. Turns
end in a line break before ``###``, where the pre-tokenizer always cuts; so the segments' tokens are those of the whole, and
segments, dealt out anew by conversation and number, are encoded and read back wherever they lie. What must run in one
stream, the digest of a conversation, gets the texts alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.bpe import tokenizer_path
from granary.llm.common import columns_kept, map_slices, read, ship

SEGMENT_CHARS = 1 << 16
HEAD, COLON, TAIL = "### ", ": ", " </turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_END = re.compile(r"\\(?:\\|###|</turn>)|</turn>")
_ROLE = re.compile(r"(?:[^\\:]|\\(?:\\|###|</turn>|:))*")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"{HEAD}{_ROLE_CONTROL.sub(r'\\\g<0>', role)}{COLON}{escape(text)}{TAIL}" for role, text in turns)


def parse(formatted: str) -> Iterator[tuple[str, int, int]]:
    """Role, and start and end of the escaped text, of each turn. Raises ValueError where it isn't a rendering."""
    at = 0
    while at < len(formatted):
        role = _ROLE.match(formatted, at + len(HEAD))
        if not formatted.startswith(HEAD, at) or not role or not formatted.startswith(COLON, role.end()):
            raise ValueError(f"no turn starts at character {at}")
        start = role.end() + len(COLON)
        end = next((m.start() for m in _END.finditer(formatted, start) if m[0][0] != "\\"), -1) - 1
        if end < start or not formatted.startswith(TAIL, end):
            raise ValueError(f"the turn at character {at} does not end")
        yield unescape(role[0]), start, end
        at = end + len(TAIL)


@lru_cache(2)
def _tokenizer(path: str) -> Any:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def masked(formatted: str, path: str, learn: str) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Ids, the tokens' starts and ends in code points, and the loss mask: tokens that meet a text of role ``learn``."""
    spans = np.array([(a, b) for role, a, b in parse(formatted) if role == learn], np.int64).reshape(-1, 2)
    got = _tokenizer(path).encode(formatted, add_special_tokens=False)
    at = np.array(got.offsets, np.int64).reshape(-1, 2)
    k = np.searchsorted(spans[:, 1], at[:, 0], "right")
    inside = np.append(spans[:, 0], len(formatted) + 1)[k] < at[:, 1]
    return got.ids, at[:, 0], at[:, 1], inside


_RENDERED = "conv_id long, segment int, formatted string"
_SEGMENT = f"{_RENDERED}, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def _lists(parts: list[Any], kind: Any) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else [], kind))


def _rendered(chars: int) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, held, turns = None, 0, 0, []
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if turns and (conv != key or held >= chars):
                    rows.append((key, number, render(turns)))
                    number, held, turns = (number + 1 if conv == key else 0), 0, []
                key = conv
                turns.append((role or "", text or ""))
                held += len(turns[-1][1])
            if rows:
                yield _columns(rows)
        if turns:
            yield _columns([(key, number, render(turns))])

    return run


def _columns(rows: list[tuple[int | None, int, str]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "segment", "formatted"])


def _encoded(path: str, learn: str) -> Any:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [masked(f, path, learn) for f in batch.column(2).to_pylist()]
        ints = [_lists([np.asarray(x[k], np.int32) for x in found], pa.int32()) for k in range(3)]
        return pa.RecordBatch.from_arrays([*batch.columns, *ints, _lists([x[3] for x in found], pa.bool_())], ["conv_id", "segment", "formatted", "ids", "starts", "ends", "loss"])

    return run


def format_conversations(rows: DataFrame, path: str, *, learn: str = "assistant", chars: int = SEGMENT_CHARS) -> DataFrame:
    """(conv_id, segment, formatted, ids, starts, ends, loss): each conversation's rendering and its masked tokens.

    ``rows`` has conv_id, turn, role and text. Null roles and texts are empty; rows with equal or null turns follow
    each other by role and text, nulls first; repeated rows are turns of their own; a null conv_id is a conversation.
    A conversation's segments are numbered from 0 and lie in any partition. A turn is never cut, so a very long one is a
    segment of its own. Other columns don't matter, whatever their names. An empty table gives no rows.
    """
    ship(rows.sparkSession)
    own = columns_kept(rows, {c: c for c in ("conv_id", "turn", "role", "text")}).withColumn("conv_id", F.col("conv_id").cast("long"))
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    segments = dealt.mapInArrow(_rendered(chars), _RENDERED).repartition("conv_id", "segment")
    return map_slices(segments, "formatted", _encoded(path, learn), _SEGMENT)


_READ = "conv_id long, segment int, turns long, said string, learned string, long long"


def _read_back(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of each segment the number of turns, what its turns say, and all text under its loss mask."""
    rows = []
    at = batch.column(4).offsets.to_numpy() - batch.column(4).offsets[0].as_py()
    all_starts, all_ends, all_loss = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (4, 5, 6))
    for r, formatted in enumerate(batch.column(2).to_pylist()):
        loss = all_loss[at[r] : at[r + 1]].astype(bool)
        starts, ends = all_starts[at[r] : at[r + 1]][loss], all_ends[at[r] : at[r + 1]][loss]
        said, learned = [], []
        for role, a, b in parse(formatted):
            said.append(f"{role}\n{unescape(formatted[a:b])}\n")
            lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
            pos, kept = a, []
            for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True):  # parts of one character share its span
                s, e = max(s, pos), min(e, b)
                if s < e:
                    kept.append(formatted[s:e])
                    pos = e
            learned.append(unescape("".join(kept)))
        rows.append((len(said), "".join(said), "".join(learned), len(formatted)))
    turns, said, learned, long = zip(*rows, strict=True) if rows else ((), (), (), ())
    columns = [batch.column(0), batch.column(1), pa.array(turns, pa.int64()), pa.array(said, pa.string()), pa.array(learned, pa.string()), pa.array(long, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _READ.split(", ")])


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: dict[str, Any] | None = None
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def out(done: list[dict[str, Any]]) -> pa.RecordBatch:
        rows = [(s["key"], s["turns"], s["all"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["long"]) for s in done]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _DIGEST.split(", ")])

    for batch in batches:
        done = []
        for key, number, turns, said, learned, long in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or number == 0:
                if state:
                    done.append(state)
                state = {"key": key, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "long": 0}
            state["turns"] += turns
            state["all"].update(said.encode())
            state["chars"] += len(learned)
            state["loss"].update(learned.encode())
            state["long"] += long
        if done:
            yield out(done)
    if state:
        yield out([state])


def digest(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, read back from the segments that :func:`format_conversations` gave."""
    read_back = map_slices(formatted, "formatted", _read_back, _READ)
    return read_back.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_digests, _DIGEST)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = columns_kept(read(spark, sf_dir, "conversations"), {c: c for c in ("conv_id", "turn", "role", "text")})
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digest(format_conversations(rows.unionByName(extra), tokenizer_path("byte_bpe_50k.json")))


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ') + length(regexp_replace(role, '(\\|###|</turn>|:)', 'x\1', 'g')) + 2
      + length(regexp_replace(text, '(\\|###|</turn>)', 'x\1', 'g')) + length(' </turn>') + 1)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
