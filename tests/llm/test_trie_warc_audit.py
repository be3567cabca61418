"""Operators 11 to 13 against plain versions, on the given tables and on odd rows."""

import gzip
import hashlib
import io
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from granary.llm import audit, common, trie, warc

SF = "/root/testdata/sf0.001"


def clash(df, *names):
    """With columns whose names differ from the table's in case only, or are used inside."""
    return df.select("*", *[F.lit(1).alias(n) for n in names])


# ---- 13


def plain_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    told = defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        told[lang or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part, rows in told.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            alive = list(rows)
            for k, f in enumerate(order):
                gone, alive = [r for r in alive if f in r[0]], [r for r in alive if f not in r[0]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(alive), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, o, s), v in out.items():
            if p == part:
                v.append(shapley[o[s - 1]])
    return out


AUDITED = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in AUDITED] for r in df.collect()}


def test_audit_on_odd_rows(spark):
    same = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", same, same, same, "A" * 10, "a b" * 400, "x # y", "É\x0b\x0cb c", same + " $", "long word " * 60_000]
    rows = [(i, t, ["en", None, "", "fr"][i % 4]) for i, t in enumerate(texts)] + [(None, same, "en"), (None, None, None), (2, same, "en"), (1, "other", "de"), (-5, "x # y", "fr")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(9)] + [(2, 1, None), (2, None, 1), (None, 1, 1)]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "TEXT", "part", "mask", "first", "good", "digest")
    marks = clash(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "Toxic", "good")
    assert audited(audit.audit(docs, marks)) == plain_audit(rows, labels)
    none = audited(audit.audit(docs, marks.limit(0)))
    assert none == plain_audit(rows, []) and all(v[4:6] == [0, 0] for v in none.values())
    assert audit.audit(docs.limit(0), marks).count() == 0


def test_audit_inverts_exactly(spark):
    rng = random.Random(3)
    rows = [(rng.choice("pq"), rng.randrange(32), rng.random() < 0.5, rng.random() < 0.2) for _ in range(3000)]
    got = audit.cells(audit.spectrum(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean"))).collect()
    for r in got:
        for name, where in (("n", lambda x: True), ("good", lambda x: x[2]), ("toxic", lambda x: x[3])):
            assert r[name] == [sum(x[0] == r["part"] and x[1] == m and bool(where(x)) for x in rows) for m in range(32)]


# ---- 12


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in kids[p])
    end = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], end(p)) for p, m in members.items())


def built(df):
    return sorted(map(tuple, df.collect()))


def conversations(spark, rows):
    return clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "TURN", "pos", "depth", "digest", "node", "rep")


def test_trie_on_odd_rows(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", None, "", "1:x"])) for c in range(-12, 60) for t in range(rng.randrange(0, 6))]
    rows += [(100 + c, t, "user", f"same {t}") for c in range(8) for t in range(14)]  # copies that go deep together
    rows += [(200 + c, t, "user", f"same {t}") for c in range(8) for t in range(c + 9)]  # each the start of the next
    rows += [(300, None, "user", "null turn"), (300, 1, None, None), (300, 1, None, None), (300, 1, "user", "tie"), (None, 1, "user", "nobody"), (301, None, None, None)]
    rows += [(400, t, "user", f"{t}" if t % 7 else "x" * 50_000) for t in range(120)] + [(405, t, "user", f"{t}" if t % 7 else "x" * 50_000) for t in range(120)]
    assert built(trie.trie(conversations(spark, rows))) == plain_trie(rows)


def test_trie_of_little(spark):
    assert trie.trie(conversations(spark, [(None, 1, "user", "x")])).count() == 0
    assert trie.trie(conversations(spark, []).limit(0)).schema.simpleString() == trie.trie(conversations(spark, [(7, 0, "user", "x")])).schema.simpleString()
    for rows in ([(7, 0, "user", "x")], [(0, t, "user", "x") for t in range(3)], [(c, 0, "user", "x") for c in range(5)]):
        assert built(trie.trie(conversations(spark, rows))) == plain_trie(rows)


def test_trie_of_the_table(spark):
    rows = [tuple(r) for r in common.read(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert built(trie.op12_prefix_trie(spark, SF)) == plain_trie(rows)


# ---- 11


def plain_warc(rows, least=1000):
    groups = defaultdict(list)
    for i, _, html in rows:
        groups[(html or "").encode()].append(i)
    out = []
    for payload, ids in groups.items():
        head = max((i for i in ids if i is not None), default=None)
        rest = list(ids)
        rest.remove(head)
        said = (len(payload), hashlib.sha1(payload).hexdigest())
        if len(payload) >= least:
            out += [(head, *said, "response", None)] + [(i, *said, "revisit", head) for i in rest]
        else:
            out += [(i, *said, "response", None) for i in ids]
    return sorted(out, key=repr)


def pages_of(spark, rows):
    return clash(spark.createDataFrame(rows, "page_id long, url string, html string"), "HTML", "digest", "key", "head", "payload")


def pages_read(found):
    number = lambda u: int(m[1]) if (m := re.match(r"urn:page:(-?\d+)", u or "")) else None
    rows = found.filter("type <> 'warcinfo'").collect()
    return sorted(((number(r.record_id), r.payload_bytes, r.payload_digest, r.type, number(r.refers_to)) for r in rows), key=repr), rows


def odd_pages():
    rng = random.Random(11)
    big = "".join(chr(rng.randrange(33, 1000)) for _ in range(200_000))
    long = "y" * 1500
    rows = [(1, "http://a/", long), (5, "http://b/\r\nWARC-Type: response", long), (3, None, long), (3, "http://c/", long), (None, "http://d/ é", long)]
    rows += [(6, "u", "z" * 999), (7, "u", "z" * 999), (8, "u", None), (9, "u", ""), (10, "u", "é" * 500), (11, "u", "é" * 500), (12, "u", big), (-13, "u", big), (5, "http://b/", long), (14, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60)]
    return rows + [(100 + i, f"http://x/{i}", big[i * 300 : i * 300 + 900 + i]) for i in range(150)]


@pytest.mark.parametrize("split", [997, 20_000, 8 << 20])
def test_archives_round_trip(spark, tmp_path, split):
    rows = odd_pages()
    files = warc.write_archives(pages_of(spark, rows), str(tmp_path / "w"), archive=60_000)
    told = files.collect()
    assert sum(r.records for r in told) == len(rows) and len(told) > 4
    assert {r.path: r.bytes for r in told} == {r.path: r.bytes for r in warc.archives_in(spark, str(tmp_path / "w")).collect()}
    got, records = pages_read(warc.read_archives(spark, files, split=split))
    assert got == plain_warc(rows)
    assert len({r.record_id for r in records}) == len(rows)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes for r in records if r.type == "response")


def test_archives_are_gzip_that_others_read(spark, tmp_path):
    files = warc.write_archives(pages_of(spark, odd_pages()), str(tmp_path / "w")).collect()
    whole = b"".join(gzip.decompress(open(r.path, "rb").read()) for r in files)
    assert whole.count(b"WARC/1.1\r\nWARC-Type: re") >= len(odd_pages())


def test_damaged_archives(spark, tmp_path):
    """A damaged member is left out, as is one that is cut short; all others are read, at any split, each once."""
    members = [warc.record("response", f"urn:page:{i}", "u", bytes([i % 256, 31, 139, 8]) * (50 + 40 * i), hashlib.sha1(bytes([i % 256, 31, 139, 8]) * (50 + 40 * i)).hexdigest(), None, level=i % 2) for i in range(40)]
    broken = bytearray(members[7])
    broken[len(broken) // 2] ^= 255
    data = b"junk" + b"".join([*members[:7], bytes(broken), *members[8:]]) + warc.MAGIC * 5 + members[3][:40]
    for split in (64, 1000, len(data) + 1):
        got = [x for a in range(0, len(data), split) for x in warc.records(_File(data), len(data), a, min(a + split, len(data)))]
        assert [x[1]["warc-record-id"] for x in got] == [f"<urn:page:{i}>" for i in range(40) if i != 7]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    files = warc.archives_in(spark, str(tmp_path)).unionByName(spark.createDataFrame([(str(path), len(data) + 500)], "path string, bytes long"))
    assert warc.read_archives(spark, files, split=300).count() == 78


class _File:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return io.BytesIO(self.data[at : at + n]).read()


def test_no_pages(spark, tmp_path):
    files = warc.write_archives(pages_of(spark, []).limit(0), str(tmp_path / "w"))
    assert files.count() == 0 and warc.read_archives(spark, files).count() == 0
