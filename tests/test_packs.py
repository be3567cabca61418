"""Packs in chunks: gone on with, begun anew, damaged before and after unpacking."""

import gzip
import hashlib
import os
import zlib

import pytest

from granary.sources import packs


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture
def files(tmp_path, monkeypatch):
    monkeypatch.setattr(packs, "CHUNK", 64)
    os.makedirs(tmp_path / "from")
    os.makedirs(tmp_path / "to")
    plain = os.urandom(3000) + b"0" * 200_000
    body = gzip.compress(plain[:1000]) + gzip.compress(plain[1000:])
    (tmp_path / "from/x.gz").write_bytes(body)
    fetch = lambda a=sha(body), b=sha(plain): packs.fetch_one(str(tmp_path / "from"), str(tmp_path / "to"), "x.gz", a, b)
    return tmp_path, plain, body, fetch


def left(tmp_path):
    return sorted(os.listdir(tmp_path / "to"))


@pytest.mark.parametrize(("begun", "resumed"), [(None, 0), (b"", 0), (1, 1), (1500, 1500), (-1, -1), (b"wrong", 0), (b"w" * 999_999, 0)])
def test_fetched_whatever_was_there(files, begun, resumed):
    tmp_path, plain, body, fetch = files
    if begun is not None:
        (tmp_path / "to/x.gz.part").write_bytes(begun if isinstance(begun, bytes) else body[: begun % len(body)])
    assert fetch() == ("fetched", resumed % len(body), len(plain), sha(plain)) and (tmp_path / "to/x").read_bytes() == plain
    assert left(tmp_path) == ["x"] and fetch()[0] == "there"
    (tmp_path / "to/x").write_bytes(b"changed")
    assert fetch()[0] == "fetched" and (tmp_path / "to/x").read_bytes() == plain


def test_damage_leaves_nothing(files):
    tmp_path, plain, body, fetch = files
    assert fetch(b=sha(b"other"))[0] == "damaged" and left(tmp_path) == []
    for bad in (body[:-3], body[:50] + b"x" + body[51:], b"no gzip"):
        (tmp_path / "from/x.gz").write_bytes(bad)
        assert fetch()[0] == "damaged" and left(tmp_path) == []  # its digest is not what was told
        assert fetch(a=sha(bad))[0] == "damaged" and left(tmp_path) == []  # its digest is, but it can't be unpacked
    os.remove(tmp_path / "from/x.gz")
    assert fetch() == ("missing", 0, None, None)


def test_unpacking_holds_a_chunk(monkeypatch):
    monkeypatch.setattr(packs, "CHUNK", 1000)
    bomb = gzip.compress(b"\0" * 5_000_000)
    assert all(len(x) <= 1000 for x in packs.unpacked([bomb])) and sum(map(len, packs.unpacked([bomb[:7], bomb[7:]]))) == 5_000_000
    assert list(packs.unpacked([])) == [] and list(packs.unpacked([gzip.compress(b"")])) == []
    with pytest.raises(zlib.error):
        list(packs.unpacked([bomb[:-1]]))


def test_packs_from_rows(spark, tmp_path):
    rows = [(p, o, f"é{p}-{o} " * 50 if o % 3 else None) for p in range(6) for o in range(20)]
    manifest = packs.write(spark.createDataFrame(rows, "pack long, ord long, text string").repartition(5), f"{tmp_path}/a").persist()
    told = {r.name: r for r in manifest.collect()}
    for p in range(6):
        body = "".join(t or "" for q, _, t in rows if q == p).encode()
        r, packed = told[f"{p}.gz"], (tmp_path / f"a/{p}.gz").read_bytes()
        assert gzip.decompress(packed) == body and (r.bytes, r.sha256, r.unpacked_bytes, r.unpacked_sha256) == (len(packed), sha(packed), len(body), sha(body))
    assert sorted(os.listdir(tmp_path / "a")) == sorted(told)
    assert {r.status for r in packs.fetch(manifest, f"{tmp_path}/a", f"{tmp_path}/b").collect()} == {"fetched"}
    assert packs.write(manifest.limit(0).selectExpr("name pack", "bytes ord", "name text"), f"{tmp_path}/c").count() == 0
