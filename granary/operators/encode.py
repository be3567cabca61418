"""Texts to unit vectors: prefix, tokens, a model that can be exchanged, pooling, length one.

No weights are at hand. The default model hashes tokens to fixed pseudo-random vectors: it exercises the whole way from
text to fused results, but its rankings mean nothing. An ONNX session can stand in its place.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from granary.functions.tokenizers import Unigram, WordPiece, letters_vocab
from granary.sources.files import located

Model = Callable[[list[int], list[int]], np.ndarray]


@dataclass(frozen=True)
class HashModel:
    """One state a token: the bytes of SHA-256 of its id and of the number of each 32 of them, from -1 to 1."""

    dim: int = 64

    def __call__(self, ids: list[int], mask: list[int]) -> np.ndarray:
        digest = lambda i: b"".join(hashlib.sha256(f"{i}:{k}".encode()).digest() for k in range(-(-self.dim // 32)))[: self.dim]
        rows = [np.frombuffer(digest(i), np.uint8) for i in ids]
        return (np.array(rows, float) / 127.5 - 1) if rows else np.zeros((0, self.dim))


@dataclass
class OnnxModel:
    """The hidden states of an ONNX encoder; a Python worker opens a session once."""

    path: str
    _held: Any = field(default=None, repr=False)

    def __call__(self, ids: list[int], mask: list[int]) -> np.ndarray:
        if self._held is None:
            import onnxruntime

            self._held = onnxruntime.InferenceSession(self.path)
        names = {i.name for i in self._held.get_inputs()}
        feed = {"input_ids": np.array([ids], np.int64), "attention_mask": np.array([mask], np.int64), "token_type_ids": np.zeros((1, len(ids)), np.int64)}
        return self._held.run(None, {k: v for k, v in feed.items() if k in names})[0][0]

    def __getstate__(self) -> dict[str, Any]:
        return {"path": self.path, "_held": None}


#: The model where a manifest names none, and the least length that a shared session takes.
DEFAULT_MODEL, LEAST_LENGTH = "bge-small-en-v1.5", 256


@dataclass(frozen=True)
class Options:
    """What a manifest says of its encoder; what it leaves out is none, and the tokenizer's defaults hold."""

    model: str | None = None
    tokenizer: str | None = None
    pooling: str | None = None
    query_prefix: str | None = None
    doc_prefix: str | None = None
    length: int | None = None
    lower: bool = True
    strip_accents: bool = True

    @classmethod
    def of(cls, manifest: Mapping[str, Any]) -> Options:
        names = {"model": "model_dir", "tokenizer": "tokenizer", "pooling": "pooling", "query_prefix": "query_prefix", "doc_prefix": "doc_prefix", "length": "max_len", "lower": "lowercase", "strip_accents": "strip_accents"}
        return cls(**{k: manifest[m] for k, m in names.items() if manifest.get(m) is not None})

    def session(self) -> tuple[str | None, ...]:
        """What two indexes share if one session serves both: not how long texts may be."""
        return self.model or DEFAULT_MODEL, self.tokenizer, self.pooling, self.query_prefix

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.session(), separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:12]


def shared(options: Mapping[str, Options]) -> dict[str, tuple[str, int]]:
    """(fingerprint, length) of the session that serves each index: the longest that any of them asks for, LEAST_LENGTH at
    least."""
    length: dict[str, int] = {}
    for o in options.values():
        length[o.fingerprint()] = max(length.get(o.fingerprint(), LEAST_LENGTH), o.length or 0)
    return {n: (o.fingerprint(), length[o.fingerprint()]) for n, o in options.items()}


def fingerprint_column(model: Column, tokenizer: Column, pooling: Column, prefix: Column) -> Column:
    """:meth:`Options.fingerprint` as an expression over a registry's columns."""
    session = F.to_json(F.array(F.coalesce(model, F.lit(DEFAULT_MODEL)), tokenizer, pooling, prefix))
    return F.substring(F.sha2(session, 256), 1, 12)


@dataclass
class Encoder:
    """Texts are encoded one by one: what shares a batch would change the last digits of quantised models."""

    tokenizer: WordPiece | Unigram = field(default_factory=lambda: WordPiece(letters_vocab()))
    model: Model = field(default_factory=HashModel)
    pooling: str = "cls"
    query_prefix: str = ""
    doc_prefix: str = ""

    def vector(self, text: str | None, prefix: str) -> np.ndarray:
        ids = self.tokenizer.encode(prefix + (text or ""))
        states = np.asarray(self.model(ids, [1] * len(ids)), float)
        if self.pooling not in ("cls", "mean"):
            raise ValueError(f"pooling is cls or mean, not {self.pooling!r}")
        v = states[0] if self.pooling == "cls" and len(states) else states.mean(0) if len(states) else np.zeros(1)
        return (v / (np.linalg.norm(v) or 1e-12)).astype(np.float32)

    def query(self, text: str | None) -> list[float]:
        return self.vector(text, self.query_prefix).tolist()

    def column(self, text: Column) -> Column:
        def run(col: pa.Array) -> pa.Array:
            return pa.array([self.vector(t, self.doc_prefix) for t in col.to_pylist()], pa.list_(pa.float32()))

        return F.arrow_udf(run, ArrayType(FloatType()), F.ArrowUDFType.SCALAR)(text)

    def fingerprint(self) -> str:
        """What two encoders share if one session serves both: not how long texts may be."""
        key = [repr(self.model), type(self.tokenizer).__name__, self.pooling, self.query_prefix]
        return hashlib.sha256("|".join(key).encode()).hexdigest()[:12]


#: Tokens of a padded batch; sessions that this process holds, by what they are of.
BATCH_TOKENS = 16_384
_SESSIONS: dict[str, Any] = {}


def session(key: str, model: bytes) -> Any:
    """The process' one session for a model; ``key`` is the model's digest. One thread, as a task has one core."""
    if key not in _SESSIONS:
        import onnxruntime

        how = onnxruntime.SessionOptions()
        how.intra_op_num_threads = how.inter_op_num_threads = 1
        _SESSIONS[key] = onnxruntime.InferenceSession(model, how, providers=["CPUExecutionProvider"])
    return _SESSIONS[key]


def pooled(states: np.ndarray, mask: np.ndarray, pooling: str) -> np.ndarray:
    """A unit vector of each text from its tokens' states (texts, tokens, numbers)."""
    if pooling not in ("cls", "mean"):
        raise ValueError(f"pooling is cls or mean, not {pooling!r}")
    if pooling == "cls":
        v = states[:, 0].astype(float)
    else:
        m = mask[:, :, None].astype(float)
        v = (states * m).sum(1) / np.maximum(m.sum(1), 1e-9)
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def padded_batches(tokens: Sequence[Sequence[int]], pad: int, most: int = BATCH_TOKENS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, ids, mask) of batches of texts of like length, of at most ``most`` tokens with their padding, or of one text."""
    order = sorted(range(len(tokens)), key=lambda i: len(tokens[i]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * len(tokens[order[hi]]) <= most:
            hi += 1
        at = np.array(order[lo:hi])
        wide = max(1, len(tokens[at[-1]]))
        ids, mask = np.full((len(at), wide), pad, np.int64), np.zeros((len(at), wide), np.int64)
        for r, i in enumerate(at):
            ids[r, : len(tokens[i])] = tokens[i]
            mask[r, : len(tokens[i])] = 1
        yield at, ids, mask
        lo = hi


def encode_texts(docs: DataFrame, key: str, text: str, model: str, tokenizer: WordPiece | Unigram, *, pooling: str = "cls", prefix: str = "", pad: int = 0, most: int = BATCH_TOKENS) -> DataFrame:
    """(key, vector) of every text, by an ONNX encoder. The model's file goes to each executor once, a Python worker opens one session of it, and texts
    of an Arrow batch are sorted by length and padded together. A null text is an empty one. Vectors of quantised models may differ in their last
    digits by what shares a batch."""
    system, at = located(model)
    with system.open_input_stream(at, compression=None) as f:
        body = f.read()
    digest, sent = hashlib.sha256(body).hexdigest(), docs.sparkSession.sparkContext.broadcast(body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = held or session(digest, sent.value)
            names = {i.name for i in held.get_inputs()}
            tokens = [tokenizer.encode(prefix + (t or "")) for t in batch.column(1).to_pylist()]
            out: list[Any] = [None] * len(tokens)
            for places, ids, mask in padded_batches(tokens, pad, most):
                feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
                states = held.run(None, {k: v for k, v in feed.items() if k in names})[0]
                for i, v in zip(places, pooled(states, mask, pooling), strict=True):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float32()))], [key, "vector"])

    return docs.select(key, text).mapInArrow(run, StructType([docs.schema[key], StructField("vector", ArrayType(FloatType()))]))


def encode_for(docs: DataFrame, key: str, text: str, indexes: Mapping[str, Options], models: Mapping[str, str], tokenizer: Callable[[str | None, int], WordPiece | Unigram], **how: Any) -> DataFrame:
    """(index, fingerprint, key, vector): every text for every index. Indexes of one fingerprint share a session, and so their texts are encoded once; ``models`` has
    the file of each model, ``tokenizer`` makes what a manifest names for a length."""
    parts = []
    for mark in sorted({mark for mark, _ in shared(indexes).values()}):
        names = sorted(n for n, (m, _) in shared(indexes).items() if m == mark)
        o, length = indexes[names[0]], shared(indexes)[names[0]][1]
        own = encode_texts(docs, key, text, models[o.model or DEFAULT_MODEL], tokenizer(o.tokenizer, length), pooling=o.pooling or "cls", prefix=o.query_prefix or "", **how)
        parts.append(own.select(F.explode(F.array(*map(F.lit, names))).alias("index"), F.lit(mark).alias("fingerprint"), key, "vector"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def masked_mean(states: Sequence[Sequence[float]], mask: Sequence[int]) -> list[float]:
    m = np.array(mask, float)[:, None]
    return ((np.array(states, float) * m).sum(0) / max(m.sum(), 1e-9)).tolist()
