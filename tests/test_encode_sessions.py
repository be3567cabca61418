"""Texts through an ONNX encoder in padded batches: as one by one, one session a worker, shared by fingerprint."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions.tokenizers import WordPiece, letters_vocab
from granary.operators import encode
from granary.plans import tables as T

SF = "/root/testdata/sf0.001"


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def tensor(name, a):
    kind = {np.dtype("f4"): 1, np.dtype("i8"): 7}[a.dtype]
    return b"".join(field(1, d) for d in a.shape) + field(2, kind) + field(8, name) + field(9, a.tobytes())


def told(name, kind, *dims):
    shape = b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d)) for d in dims)
    return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))


def node(op, inputs, output):
    return b"".join(field(1, i) for i in inputs) + field(2, output) + field(4, op)


def small_encoder(seed, vocab=100, dim=6):
    """Tokens' vectors times a matrix, plus the mask, so that a text's states depend on its own tokens."""
    rng = np.random.default_rng(seed)
    table, turn = rng.normal(size=(vocab, dim)).astype("f4"), rng.normal(size=(dim, dim)).astype("f4")
    nodes = [node("Gather", ["table", "input_ids"], "a"), node("MatMul", ["a", "turn"], "b"), node("Tanh", ["b"], "last_hidden_state")]
    graph = b"".join(field(1, n) for n in nodes) + field(2, "g") + field(5, tensor("table", table)) + field(5, tensor("turn", turn))
    graph += field(11, told("input_ids", 7, "b", "t")) + field(12, told("last_hidden_state", 1, "b", "t", dim))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13)), table, turn


@pytest.fixture
def model(tmp_path):
    body, table, turn = small_encoder(1)
    path = tmp_path / "m.onnx"
    path.write_bytes(body)
    return str(path), table, turn


@pytest.mark.parametrize(("pooling", "most"), [("cls", 64), ("mean", 64), ("mean", encode.BATCH_TOKENS)])
def test_batches_equal_single_texts(spark, model, pooling, most):
    path, table, turn = model
    tokens = WordPiece(letters_vocab())
    docs = T.read(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    got = {r.doc_id: np.array(r.vector) for r in encode.encode_texts(docs, "doc_id", "text", path, tokens, pooling=pooling, prefix="about: ", most=most).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    alone = encode.OnnxModel(path)
    for r in rows:
        ids = tokens.encode("about: " + (r.text or ""))
        states = np.tanh(table[ids].astype(float) @ turn)
        v = states[0] if pooling == "cls" else states.mean(0)
        assert np.allclose(got[r.doc_id], v / np.linalg.norm(v), atol=1e-5)
    for r in rows[:20]:
        one = encode.Encoder(tokens, alone, pooling, doc_prefix="about: ").vector(r.text, "about: ")
        assert np.allclose(got[r.doc_id], one, atol=1e-6)


def test_padded_batches_hold_each_text_once():
    rng = np.random.default_rng(0)
    tokens = [list(range(int(n))) for n in rng.integers(0, 50, 200)] + [list(range(500))]
    seen = []
    for at, ids, mask in encode.padded_batches(tokens, 9, 300):
        assert ids.size <= 300 or len(at) == 1
        for r, i in enumerate(at):
            assert ids[r, mask[r] == 1].tolist() == tokens[i] and (ids[r, mask[r] == 0] == 9).all()
        seen += at.tolist()
    assert sorted(seen) == list(range(201)) and list(encode.padded_batches([], 0)) == []


def test_indexes_share_by_fingerprint(spark, model, tmp_path):
    path, *_ = model
    (tmp_path / "n.onnx").write_bytes(small_encoder(2)[0])
    options = {"a": encode.Options(model="m", length=100), "b": encode.Options(model="m", length=400), "c": encode.Options(model="n"), "d": encode.Options(model="m", pooling="mean")}
    asked = []
    make = lambda name, length: asked.append(length) or WordPiece(letters_vocab())
    docs = spark.createDataFrame([(i, f"text {'ab' * i}") for i in range(30)], "id long, text string")
    out = encode.encode_for(docs, "id", "text", options, {"m": path, "n": str(tmp_path / "n.onnx")}, make)
    rows = {(r["index"], r.id): r for r in out.collect()}
    assert len(rows) == 120 and sorted(asked) == [256, 256, 400]
    assert all(rows["a", i].vector == rows["b", i].vector and rows["a", i].fingerprint == rows["b", i].fingerprint for i in range(30))
    assert rows["a", 3].vector != rows["c", 3].vector and rows["a", 3].vector != rows["d", 3].vector
    assert out.groupBy("fingerprint").agg(F.count("*").alias("n")).count() == 3


def test_one_session_a_process(model):
    body = open(model[0], "rb").read()
    assert encode.session("k", body) is encode.session("k", body)
