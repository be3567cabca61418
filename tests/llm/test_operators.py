"""Each operator against a plain version of itself, on odd rows as well: nulls, empty and long texts, ties, repeats,
empty tables, columns with clashing names."""

import binascii
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import bpe, chat, common, decontaminate, pii, quality, sharding, simhash, token_counts, topk, toxicity
from granary.llm.graph import components
from test_pii import plain as plain_pii

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = ("The quick brown fox jumps over the lazy dog. " * 40_000)[:1_500_000]
ODD = [None, "", " ", "\n\n", "a", "A b", "one two three", "One TWO three", "É é \x00 中文 😀", "x" * 300_000, LONG, "<|endoftext|> a <|end", "1234567890" * 30]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd_docs(spark, texts=ODD):
    """With columns whose names operators use inside, and one that differs from ``text`` in case only."""
    rows = [(i, t, "x", i, "y", None) for i, t in enumerate(texts)] + [(1, texts[1] if len(texts) > 1 else None, "x", 1, "y", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, y int, score string, Text2 string")


def docs_of(spark):
    return common.read(spark, SF, "documents")


def empty(spark):
    return docs_of(spark).limit(0)


# ---- 1


def hits(text, wins):
    w, hit, items = WORD.findall(lower(text)), set(), set()
    for n in {len(k) for k in wins}:
        for i in range(len(w) - n + 1):
            found = wins.get(tuple(w[i : i + n]))
            if found:
                hit |= set(range(i, i + n))
                items |= found
    return len(w), len(hit), items


def windows(bench):
    wins = {}
    for i, t in bench:
        w = WORD.findall(lower(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    return wins


def clashing(spark, rows):
    """Documents with columns whose names differ from those of ``documents`` in case only, or are used inside operators."""
    more = (F.lit("t").alias("TEXT"), F.lit("d").alias("DOC_ID"), F.lit(1).alias("state"), F.lit(2).alias("pii"), F.lit(3).alias("toxicity"), F.lit(4).alias("found"), F.lit(5).alias("_1"), F.lit(6).alias("__gone"))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return d.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *more)


def test_stages_keep_clashing_columns(spark):
    import corpus_pipeline

    rows = [*enumerate(ODD), (1, ODD[1]), (None, "no id"), (50, "mail joe.doe@mail.example.com")]
    d = clashing(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for frame in (d, d.limit(0)):
            out = stage(spark, frame, SF)
            assert out.columns == d.columns, name
            got = out.toDF(*map(str, range(len(out.columns)))).select("0", "1", "5", "6").toArrow().to_pylist()
            assert len(got) <= len(rows) and all((r["5"], r["6"]) == ("t", "d") for r in got), name
            if frame is d:
                assert {r["0"] for r in got} >= {None, 4, 5, 6} and ("joe.doe" in str(got)) == (name != "pii"), name
            else:
                assert not got
    assert sharding.assign(d, "doc_id", ["a", "b"], size=7).columns == [*d.columns, "slot", "shard"]
    assert bpe.round_trip(d, bpe.tokenizer_path("byte_bpe_50k.json")).count() == len(rows)


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontamination_equals_brute_force(spark, block):
    bench = [(1, "lazy dog the"), (2, "One; two, THREE"), (3, None), (4, "!!"), (5, "中文"), (2, "one two three"), (6, " ".join(f"w{i}" for i in range(12)))]
    texts = [*ODD, "say ONE-two three! and w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 end", "w1 w2 w3 w4 w5 w6 w7 w8 w9 x"]
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {r["doc_id"]: r["contamination"] for r in decontaminate.scan(odd_docs(spark, texts), b, block=block).collect()}
    for i, t in enumerate(texts):
        n, n_hit, items = hits(t, windows(bench))
        c = got[i]
        assert (c["n_words"], sum(s["b"] - s["a"] for s in c["hit"]), set(c["items"])) == (n, n_hit, items), i


def test_decontamination_removes(spark):
    b = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    d = spark.createDataFrame([(1, "One, two three FOUR. five"), (2, "clean text"), (3, None)], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.decontaminate(d, b).collect()} == {2, 3}
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(d, b, remove="spans").collect()}
    assert spans == {1: "One, . five", 2: "clean text", 3: None}
    assert decontaminate.decontaminate(d, b.limit(0)).count() == 3
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(d, b, remove="all")


def test_op1_on_the_tables(spark):
    rows = {r.doc_id: r for r in decontaminate.op1_decontaminate(spark, SF).collect()}
    wins = windows([tuple(r) for r in common.read(spark, SF, "benchmark").select("item_id", "text").collect()])
    for r in docs_of(spark).collect():
        n, n_hit, items = hits(r.text, wins)
        sha = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        assert tuple(rows[r.doc_id])[1:6] == (n, n_hit, len(items), sha, n_hit > 0)


# ---- 2 and 3


def random_texts(n):
    rng = random.Random(5)
    parts = ["a", " ", "  ", "\n", "'s", "é", "1", "²", "中", "😀", "́", "\xa0", "\x1c", "\x85", "<|endoftext|>", "aaaa", "....", "\t", "\x00", "Hello", "the", "ing", "▁", "<s>", "</s>", "<0x0A>"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    texts = [*ODD, *random_texts(800)]
    got = {r.doc_id: r for r in bpe.round_trip(odd_docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), i
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(empty(spark), path).count() == 0
    back = bpe.encode_documents(odd_docs(spark, texts[:9]), path).select("doc_id", bpe.decode_column(F.col("ids"), path).alias("t"))
    assert {r.doc_id: r.t for r in back.collect()} == {i: t or "" for i, t in enumerate(texts[:9])}


def test_op2_and_op3_on_the_tables(spark):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.no_truncation()
    pieces = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in docs_of(spark).collect()}
    coded = {r.doc_id: r for r in bpe.op2_bpe(spark, SF).collect()}
    counted = {r.doc_id: r for r in token_counts.op3_token_counts(spark, SF).collect()}
    assert set(coded) == set(counted) == set(texts)
    for i, t in texts.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert (coded[i].n_tokens, coded[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert coded[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        n = len(pieces.encode(t))
        assert (counted[i].n_bytes, counted[i].n_tokens, counted[i].over_limit) == (len(t.encode()), n, n > 4096)


def test_token_counts_equal_the_library(spark, monkeypatch):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = SentencePieceProcessor(model_file=path)
    texts = [*ODD, *random_texts(800)]
    got = {r.doc_id: r for r in token_counts.token_counts(odd_docs(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        n = len(lib.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 4096), i
    monkeypatch.setattr(token_counts, "PIECE_CHARS", 3)
    assert token_counts.counter(path).count([t or "" for t in texts[-300:]]) == [len(lib.encode(t)) for t in texts[-300:]]
    assert token_counts.token_counts(empty(spark), path).count() == 0


# ---- 4 and 5


def labelled(spark):
    rng = random.Random(1)
    plain = ["river", "stone", "cloud", "table", "window", "paper", "green", "seven"]
    rows, labels = [], []
    for i in range(400):
        sentences = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(rng.randint(1, 9))]
        toxic, bad = i % 5 == 0, i % 4 == 1
        if toxic:
            sentences[rng.randrange(len(sentences))] += " you " + rng.choice(["grobulent", "grobulite", "snarfish"])
        lines = [s.capitalize() + "." for s in sentences]
        if bad:
            lines = [" | ".join(s.split()) for s in lines] * 2
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, LONG), (3, rows[3][1])], "doc_id long, text string").withColumn("y", F.lit("c")).withColumn("sentences", F.lit(1))
    return docs, spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")


def test_toxicity_finds_sentences(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == 403 and toxicity.score(docs, labels).count() == 404
    wrong = [i for i in range(400) if (got[i].score >= 0.5) != (i % 5 == 0)]
    assert len(wrong) <= 4
    assert got[900].score == got[901].score == 0 and got[902].score < 0.5
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in range(0, 400, 5):
        for s in got[i].sentences:
            assert re.search("grobul|snarf", texts[i][s.start : s.end])
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 for r in docs.collect() if got[r.doc_id].score < 0.5)
    assert toxicity.score(docs, labels.limit(0)).filter("score >= 0.5").count() == 0
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_toxicity_does_not_depend_on_the_word_cache(spark, monkeypatch):
    offending = [f"{a}{b}zq" for a in "abc" for b in "xyz"]
    docs = spark.createDataFrame([(i, f"plain{i} words. " + " ".join(offending[: i + 1]) + " here.") for i in range(9)], "doc_id long, text string").coalesce(1)
    model = ({w: 2.0 for w in offending}, -9.0, -12.0)
    scores = lambda: {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score_column(F.col("text"), *model).score.alias("s")).collect()}
    want = {i: 1 - 1 / (1 + np.exp(-12)) / (1 + np.exp(2.0 * (i + 1) - 9)) for i in range(9)}
    assert scores() == pytest.approx(want)
    monkeypatch.setattr(toxicity, "_CACHE", 5)
    assert scores() == pytest.approx(want)


def test_held_out_rows_are_not_learned(spark):
    docs, labels = labelled(spark)
    held = labels.filter("crc32(cast(doc_id as string)) % 5 = 0")
    turned = labels.filter("crc32(cast(doc_id as string)) % 5 <> 0").unionByName(held.withColumn("toxic", 1 - F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, turned)


def plain_toxicity(text, weights, bias, leak):
    word, chance = re.compile(r"[^\W\d_]+"), lambda z: 1 / (1 + np.exp(-z))
    weigh = lambda w: sum(weights.get(f, 0.0) for f in (w, *(w[:n] + "*" for n in (4, 5) if len(w) > n)))
    clean = 1 - chance(leak) if word.search((text or "").lower()) else 1.0
    for s in re.findall(r"[^.!?\n]+", text or ""):
        own = [x for w in set(word.findall(s.lower())) if (x := weigh(w))]
        clean *= 1 - chance(bias + sum(own)) if own else 1.0
    return 1 - clean


def test_op4_on_the_tables(spark):
    """Every score of the query against the definition, worked out word by word from the weights."""
    docs, labels = docs_of(spark), common.read(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = toxicity.op4_toxicity(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.score == pytest.approx(plain_toxicity(texts[r.doc_id], *model), abs=1e-9)
        assert (r.predicted, r.held_out) == (int(r.score >= 0.5), binascii.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_toxicity_takes_every_feature_that_passes(spark):
    words = [f"{a}{b}{c}zq" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnop" for c in "abcdefghijklmnop"]
    rows = [(i, f"plain river {i % 7}." if i % 2 else " ".join(words) + ".") for i in range(40)]
    rows = [(i, t if i % 2 else f"{t} only{i}") for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert set(words) <= set(toxicity.fit(docs, labels, steps=2)[0]) and len(words) > 5000


def test_op5_on_the_tables(spark):
    """Every score of the query against a forward-backward pass in plain Python, line by line."""
    docs, labels = docs_of(spark), common.read(spark, SF, "labels")
    m = quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality.op5_quality(spark, SF).collect()
    assert len(rows) == len(texts)
    e = np.exp(m.moves)
    for r in rows:
        x, n = quality.line_features(texts[r.doc_id] or "")
        score = 0.0
        if len(n):
            good = np.exp(quality.with_neighbours(x) @ m.theta)
            ahead, behind = [np.array([1.0, good[0]])], [np.array([1.0, 1.0])]
            for u in good[1:]:
                f = ahead[-1] @ e * np.array([1.0, u])
                ahead.append(f / f.sum())
            for u in good[:0:-1]:
                b = e @ (behind[-1] * np.array([1.0, u]))
                behind.append(b / b.sum())
            p = np.array([f * b / (f * b).sum() for f, b in zip(ahead, behind[::-1], strict=True)])[:, 1]
            score = 1 / (1 + np.exp(-(m.slope * (p * n).sum() / n.sum() + m.shift)))
        assert r.score == pytest.approx(score, abs=1e-6)
        assert (r.predicted, r.held_out) == (int(r.score >= 0.3), binascii.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality_learns_from_long_documents(spark):
    """Labels of documents of 5,000 lines are all there are; and chains are drawn alike from long and short ones."""
    good = "\n".join(f"The river {i} runs past green stones and quiet houses." for i in range(5000))
    bad = "\n".join(f"win | win | {i} | $$$ | click" for i in range(5000))
    rows = [(1, good), (2, bad), (3, good + "\nMore."), (4, bad + "\n$$$ | x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    kept = [i for i, _ in rows if binascii.crc32(str(i).encode()) % 5]
    assert {i % 2 for i in kept} == {0, 1}
    got = {r.doc_id: r.score for r in quality.score(docs, labels, lines=12_000).collect()}
    assert all((got[i] >= 0.3) == bool(i % 2) for i in got)
    text = "\n".join(f"line {i}" for i in range(2500))
    batch = pa.RecordBatch.from_arrays([pa.array([text, "a\nb"]), pa.array([1, 0], pa.int32())], ["text", "y"])
    assert sorted(len(r["n"]) for r in quality._sampled(1.0, 1000)(batch).to_pylist()) == [2, 500, 1000, 1000]
    assert quality._sampled(0.0, 1000)(batch).num_rows == 0


def test_quality_of_lines(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert sum((got[i].score >= 0.3) != (i % 4 != 1) for i in range(400)) <= 4
    assert got[900].score == got[901].score == 0 and 0 <= got[902].score <= 1
    assert quality.score(docs, labels.limit(0)).filter("score = 0.5").count() == 402
    assert quality.score(docs.limit(0), labels).count() == 0


def test_chain_equals_enumeration():
    rng = np.random.default_rng(2)
    u, moves = rng.normal(size=(1, 4)), rng.normal(size=(2, 2))
    import itertools

    paths = list(itertools.product((0, 1), repeat=4))
    w = np.array([np.exp(sum(u[0, i] * p[i] for i in range(4)) + sum(moves[p[i], p[i + 1]] for i in range(3))) for p in paths])
    w /= w.sum()
    good, pairs = quality.chain(u, np.array([4]), moves, pairs=True)
    assert np.allclose(good[0], [sum(x for x, p in zip(w, paths, strict=True) if p[i]) for i in range(4)])
    assert np.allclose(pairs, [[sum(x * sum(p[i] == a and p[i + 1] == b for i in range(3)) for x, p in zip(w, paths, strict=True)) for b in (0, 1)] for a in (0, 1)])


# ---- 6


def test_lookup_table():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 211)
    free, want = set(range(211)), [-1] * 211
    from xxhash import xxh64_intdigest

    prefer = [[(xxh64_intdigest(n, 1) + j * (xxh64_intdigest(n, 2) % 210 + 1)) % 211 for j in range(211)] for n in names]
    while free:
        for i in range(7):
            if free:
                s = next(x for x in prefer[i] if x in free)
                want[s] = i
                free.remove(s)
    assert table == want
    sizes = np.bincount(table)
    assert sizes.max() - sizes.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 211)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 60
    for bad in (dict(shards=[], size=7), dict(shards=["a", "a"], size=7), dict(shards=["a"], size=8), dict(shards=["a", "b", "c"], size=2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(**bad)


def test_placement(spark):
    from xxhash import xxh64_intdigest

    names = [f"s{i}" for i in range(5)]
    table = sharding.lookup_table(names, 1009)
    d = odd_docs(spark)
    rows = sharding.assign(d, "doc_id", names, size=1009).collect()
    assert len(rows) == d.count()
    for r in rows:
        h = xxh64_intdigest(str(r.doc_id).encode(), 42)
        slot = (h - (1 << 64) if h >> 63 else h) % 1009
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert sharding.assign(d.limit(0), "doc_id", names).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(d.withColumn("SLOT", F.lit(1)), "doc_id", names)


# ---- 7


@pytest.mark.parametrize(("n", "dim", "block", "clustered"), [(400, 6, 20_000, True), (300, 4, 7, False), (1, 3, 10, False)])
def test_top_k_equals_brute_force(spark, n, dim, block, clustered):
    rng = np.random.default_rng(n)
    v = rng.integers(-3, 4, (n, dim)) + (rng.integers(0, 4, (n, 1)) * 50 if clustered else 0)
    v[: n // 3] = v[0]  # a third of all rows are the same vector
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, codes array<long>")
    got = {}
    for r in topk.top_k(rows.repartition(7), F.col("vec_id") % 10 == 0, k=5, pivots=8, sample=64, block=block).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = {}
    for q in range(0, n, 10):
        best = sorted((-(int(v[q] @ v[j])), j) for j in range(n) if j != q)[:5]
        if best:
            want[q] = {k + 1: (j, -s) for k, (s, j) in enumerate(best)}
    assert got == want


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.5]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (5, [0.25, -0.1]), (5, [0.25, -0.1]), (None, [1.0, 1.0]), (20, [1.0]), (40, [1.0, 0.5])]
    df = topk.integer_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0).collect()))
    v = {0: (64, 32), 5: (16, -7), 20: (64, 0), 40: (64, 32)}
    want = []
    for q in (0, 20, 40):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[j], strict=True)), j) for j in v if j != q)
        want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


# ---- 8


def test_chat_round_trip():
    texts = ["", "\\", "###", "### ", "\\### x: </turn> ok", " </turn>\n### user: hi", "####", "a:b", "é😀<|endoftext|>", "\\\\###\\"]
    turns = [(r, t) for r in ("user", "assistant", "a: b", "###", "") for t in texts]
    f = chat.render(turns)
    assert [(r, chat.unescape(f[a:b])) for r, a, b in chat.parse(f)] == turns
    for bad in ("x", "### user: a", "### user a </turn>\n", "### user: a </turn>"):
        with pytest.raises(ValueError):
            list(chat.parse(bad))


def plain_digest(turns):
    said = [t or "" for r, t in turns if r == "assistant"]
    return (len(turns), hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest(), sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest(), len(chat.render([(r or "", t or "") for r, t in turns])))


@pytest.mark.parametrize("chars", [1 << 16, 20])
def test_chat_digests(spark, chars):
    rng = random.Random(3)
    bits = ["a", " ", "\n", "###", "</turn>", "\\", ": ", "é", "😀", "<|endoftext|>", "word "]
    convs = {c: [(rng.choice(["user", "assistant", "system", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) or None) for _ in range(rng.randint(1, 12))] for c in range(30)}
    convs[99] = [("user", LONG), ("assistant", LONG)]
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)] + [(None, None, "assistant", "b"), (None, None, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("x"))
    convs[None] = [("assistant", "a"), ("assistant", "b")]
    f = chat.format_conversations(df, bpe.tokenizer_path("byte_bpe_50k.json"), chars=chars)
    assert {r.conv_id: tuple(r)[1:] for r in chat.digest(f).collect()} == {c: plain_digest(t) for c, t in convs.items()}
    assert chat.digest(chat.format_conversations(df.limit(0), bpe.tokenizer_path("byte_bpe_50k.json"))).count() == 0


def test_chat_segments_have_the_tokens_of_the_whole(spark):
    turns = [("user" if i % 2 else "assistant", f"turn {i}  \n text ") for i in range(40)]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    path = bpe.tokenizer_path("byte_bpe_50k.json")
    parts = sorted(chat.format_conversations(df, path, chars=50).collect(), key=lambda r: r.segment)
    assert len(parts) > 5
    assert [i for p in parts for i in p.ids] == chat.masked(chat.render(turns), path, "assistant")[0]


# ---- 9


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    h = [xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if least[j] < least[i] and (prints[i] ^ prints[j]).bit_count() <= 3:
                    least[i], changed = least[j], True
    return least


def test_fingerprints_and_components(spark):
    texts = [t for t in ODD if t != LONG and (t is None or len(t) < 1000)] + ["  \t", "the cat sat on the mat today", "The cat  sat on the mat today", "the cat sat on the mat today!"]
    d = odd_docs(spark, texts)
    rows = simhash.near_duplicates(d).collect()
    assert len(rows) == len(texts) + 1
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = plain_components(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    kept = simhash.deduplicate(d)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == d.columns
    assert simhash.near_duplicates(d.limit(0)).count() == simhash.deduplicate(d.limit(0)).count() == 0


def test_op6_and_op9_on_the_tables(spark):
    from xxhash import xxh64_intdigest

    texts = {r.doc_id: r.text for r in docs_of(spark).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(prints)
    rows = simhash.op9_simhash(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}
    names = [f"shard-{i:05d}" for i in range(sharding.SHARDS)]
    table = sharding.lookup_table(names)
    placed = sharding.op6_sharding(spark, SF).collect()
    assert len(rows) == len(placed) == len(texts)
    for r in placed:
        h = xxh64_intdigest(str(r.doc_id).encode(), 42)
        assert (r.slot, r.shard) == ((h - (1 << 64) if h >> 63 else h) % sharding.SIZE, names[table[r.slot]])


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(random.Random(4).choice(["ab", "C", "d\te", "é"]) for _ in range(3000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_PIECE", 37)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text.decode()).to_bytes(8, "big")


def test_links_lose_none(spark):
    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for p in prints for _ in range(6)]
    prints = list(dict.fromkeys(prints))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    pairs = [tuple(sorted(r)) for r in simhash.links(df).collect()]
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3}
    assert set(pairs) == want and len(pairs) == len(want)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (7, 7)]
    edges += [(5000, i) for i in range(1000, 1300)] + [(i, 400) for i in range(2000, 2300)] + [(1000, 2000)]  # hubs
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    hubs = {400, 5000, *range(1000, 1300), *range(2000, 2300)}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200} | {i: 400 for i in hubs}


def plain_sets(texts):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        out[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    return out


def plain_kept(texts):
    """The least id of each component of links at a Jaccard similarity of 0.8 or more."""
    sets, least, changed = plain_sets(texts), {i: i for i in texts}, True
    links = [(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(least[i], least[j])
            if least[i] != low or least[j] != low:
                least[i] = least[j] = low
                changed = True
    return set(least.values())


def edited_copies():
    """Originals of 20 to 300 words, and copies with 1 to 12 words changed at random; a common line in half of them."""
    rng = random.Random(11)
    texts, line = {}, "this line stands in very many of the texts at hand"
    for i in range(40):
        w = [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(rng.choice([20, 60, 150, 300]))]
        for c in range(4):
            own = list(w)
            for _ in range(rng.randint(1, 12) if c else 0):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
            texts[1000 - 10 * i - c] = " ".join(own) + (f"\n{line}" if i % 2 else "")
    return texts


def test_edited_copies_are_near_copies(spark):
    import corpus_pipeline

    texts = edited_copies() | {1: None, 2: "", 3: "One two", 4: "one  TWO", 5: "one two three", 6: LONG}
    d = spark.createDataFrame([*texts.items(), (None, "one two"), (3, "One two")], "doc_id long, text string").repartition(3)
    want = plain_kept(texts)
    assert len(want) < len(texts) - 30
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, d, SF).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(want) and kept.count(None) == 1
    assert corpus_pipeline.drop_near_copies(spark, d.limit(0), SF).count() == 0


# ---- pipeline


def test_pipeline_on_planted_cases(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark)
    rng = random.Random(9)
    item = " ".join(f"benchword{i}" for i in range(14))
    body = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(i) for i in range(300))
    planted = [(1000, body), (1001, body.upper()), (1002, f"{body} {item}"), (1003, "Write to joe.doe@mail.example.com about river stone cloud."), (1004, "You grobulent. River stone."), (1005, "Clean river stone window paper table green seven cloud and more of it here.")]
    whole = docs.select("doc_id", "text").filter("doc_id < 400").dropDuplicates(["doc_id"]).unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    whole = whole.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in now.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == whole.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{k}")
        ids, was = {r.doc_id: r for r in now.collect()}, {r.doc_id: r.text for r in before.collect()}
        if name.startswith("toxicity"):
            assert 1004 not in ids and {1000, 1001, 1002, 1003, 1005} <= set(ids)
            model = toxicity.fit(before, labels)
            assert set(ids) == {i for i, t in was.items() if plain_toxicity(t, *model) < 0.5}
        elif name.startswith("simhash"):
            assert set(ids) == plain_kept(was)
        elif name.startswith("bench"):
            assert set(ids) == {i for i, t in was.items() if not hits(t, windows([(1, item)]))[1]}
        else:
            assert {i: r.text for i, r in ids.items()} == {i: plain_pii(t, pii.PUBLIC_KEY)[0] for i, t in was.items()}
            assert "joe.doe" not in ids[1003].text and ids[1005].text == texts[1005] and all(r.n_chars == len(r.text) for r in ids.values())
    last = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.tokenizer_path("byte_bpe_50k.json"))
    lib.no_truncation()
    coded = {i: lib.encode(r.text, add_special_tokens=False).ids for i, r in ids.items()}
    assert last == {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in coded.items()}
