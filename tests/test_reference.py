"""Operators on small inputs with known answers, odd inputs, and the shape of plans."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import letters as L
from granary.functions import numeric
from granary.functions import text as X
from granary.functions import tokenizers as tok
from granary.operators import catalogue, encode, fusion, lexical, notation, reading, render, vectors, vocab
from granary.plans import browsing, catalog, records, registry, retrieval
from granary.plans import tables as T
from granary.streaming import access_log, limits

SF = "/root/testdata/sf0.001"


def index(spark, rows, mask=None):
    v = [[x / (math.sqrt(sum(y * y for y in r)) or 1) for x in r] for r in rows]
    df = spark.createDataFrame([(i, x, mask is None or bool(mask[i])) for i, x in enumerate(v)], "id long, v array<double>, m boolean")
    return vectors.build_index(df, "id", "v", F.col("m"))


def ids(df):
    return [r.id for r in df.collect()]


def col(spark, expr, *values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").repartition(3)
    return [r.o for r in sorted(df.select("i", expr(F.col("x")).alias("o")).collect(), key=lambda r: r.i)]


# ---- vectors


def test_nearest_ties_masks(spark):
    i = index(spark, [[1, 0, 0, 0], [0, 1, 0, 0], [0.9, 0.1, 0, 0]])
    assert ids(vectors.search(i, [1, 0, 0, 0], 2)) == [0, 2]
    assert ids(vectors.similar_to(index(spark, [[1, 0, 0, 0], [0.99, 0.14, 0, 0], [0, 0, 1, 0]]), 0, 3))[0] == 1
    assert ids(vectors.search(index(spark, [[1, 1, 0, 0]] * 3 + [[0, 0, 1, 0]]), [1, 1, 0, 0], 3)) == [0, 1, 2]
    m = index(spark, [[1, 0], [0.9, 0.1], [0.8, 0.2]], [1, 0, 1])
    assert ids(vectors.search(m, [1, 0], 5)) == [0, 2]
    assert ids(vectors.similar_to(m, 1, 5)) == [] and ids(vectors.similar_to(m, 0, 5)) == [2] and ids(vectors.similar_to(m, 99, 5)) == []
    assert ids(vectors.search(m, [1, 0], 5, mask=F.col("row") > 0)) == [1, 2]
    assert [len(ids(vectors.search(i, [1, 0, 0, 0], k))) for k in (2.5, 1e10, math.inf, 0.5, math.nan)] == [2, 3, 3, 0, 0]
    for bad in ([math.nan, 0], [math.inf, 0]):
        with pytest.raises(ValueError):
            vectors.search(m, bad, 1)
    with pytest.raises(ValueError):
        vectors.search(m, [1, 0, 0], 1, dim=2)


def test_quantisation_is_close_and_kernel_equals_expression(spark):
    rows = [[math.cos(i * 1.7 + j * 0.31) for j in range(64)] for i in range(20)]
    i = index(spark, rows)
    for k in (0, 7, 19):
        n = math.sqrt(sum(x * x for x in rows[k]))
        q = [x / n for x in rows[k]]
        best = vectors.search(i, q, 1).collect()[0]
        assert best.id == k and abs(best.score - 1) < 0.01
        want = [(r.id, r.score) for r in vectors.search(i, q, 8).collect()]
        assert [(r.id, r.score) for r in vectors.search_arrow(i.repartition(5), q, 8).collect()] == want
    asked = i.select(F.col("id").alias("qid"), F.col("row").alias("qrow"), numeric.dequantize(F.col("codes"), F.col("scale")).alias("q"))
    for block in (1000, 3):
        batch = {}
        for r in vectors.neighbours_batch(i, asked, 4, block=block).collect():
            batch.setdefault(r.qid, {})[r["rank"]] = (r.id, r.score)
        one = {k: {n + 1: (r.id, r.score) for n, r in enumerate(vectors.similar_to(i, k, 4).collect())} for k in (0, 5, 11)}
        assert {k: batch[k] for k in one} == one and len(batch) == 20


def test_neighbours_in_blocks_equal_one_block(spark):
    i = index(spark, [[math.sin(a * 7 + j * 3) for j in range(8)] for a in range(60)])
    asked = i.select(F.col("id").alias("qid"), F.col("row").alias("qrow"), numeric.dequantize(F.col("codes"), F.col("scale")).alias("q"))
    rows = lambda **kw: sorted(map(tuple, vectors.neighbours_batch(i, asked, 4, **kw).collect()))
    assert rows() == rows(block=9) and len(rows()) == 240
    assert vectors.neighbours_batch(i, asked.limit(0), 4).count() == 0


def test_floor_comes_after_the_best(spark):
    hits = vectors.search(index(spark, [[1, 0], [0, 1], [-1, 0]]), [1, 0], 3)
    assert ids(vectors.score_floor(hits, 0.0)) == [0, 1] and ids(vectors.score_floor(hits, 0.0, 0.5)) == [0]


def test_multi_query(spark):
    i = index(spark, [[1, 0, 0], [0, 1, 0], [0, 0, 1]])
    got = vectors.multi_query_search(i, [[0, 0.9, 0.3], [0, 0.3, 0.9]], 3, 2).collect()
    assert [r.row for r in got] == [1, 2] and got[0].score == pytest.approx(1 / 61 + 1 / 62)


def test_rounding_and_projection(spark):
    assert col(spark, numeric.round6, -0.1234565, 0.1234565, 2.0, kind="double") == [-0.123456, 0.123457, 2.0]
    got = col(spark, lambda v: numeric.project(v, [[1.0, 0, 0], [0, 1.0, 0]], [1.0, 1.0, 1.0]), [4.0, 5.0, 1.0], [1.0, 1.0, 1.0], kind="array<float>")
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0, 0]
    assert [numeric.clamp_limit(v) for v in (2.5, -1, 1e9, math.nan, None, "x")] == [2, 0, 1000, 20, 20, 20]


def test_top_k_plan_needs_no_full_sort(spark):
    plan = vectors.search(T.index(spark, SF), retrieval._Q, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Cartesian" not in plan


# ---- fusion


def lists(spark, *given):
    rows = [(name, name, "v", w, rank + 1, k, k or 0, 1.0) for name, w, keys in given for rank, k in enumerate(keys)]
    return spark.createDataFrame(rows, "list_id string, index string, via string, weight double, rank int, key long, id long, score double")


def test_fusion(spark):
    got = fusion.fuse_by(lists(spark, ("A", None, [10, 10, 20]), ("B", None, [20, 30])), 10).collect()
    assert [r.key for r in got] == [20, 10, 30] and [r.votes for r in got] == [2, 1, 1]
    assert got[0].score == round(1 / 63 + 1 / 61, 6) and got[1].score == round(1 / 61, 6)
    assert [h["index"] for h in got[0].hits] == ["A", "B"]
    w = fusion.fuse_by(lists(spark, ("A", 2.0, [1]), ("B", 0.0, [2]), ("C", float("nan"), [3]), ("D", None, [None, 4])), 10).collect()
    assert [(r.key, r.score) for r in w] == [(1, round(2 / 61, 6)), (3, round(1 / 61, 6)), (4, round(1 / 62, 6))]
    tie = fusion.fuse_by(lists(spark, ("A", None, [7]), ("B", None, [3])), 1).collect()
    assert [r.key for r in tie] == [3]


# ---- letters


def test_codes(spark):
    assert col(spark, L.query_codes, "ਕਨਜਤ", " ਕ ਨ", None, "ਸ਼", "ਸ਼", "a+") == [",107,110,106,113", ",107,110", "", ",115", ",115", ",097+"]
    assert col(spark, L.variant_codes, ",115,110,115", ",110,113") == [",083,110,083", None]
    assert col(spark, L.suffix_tokens, ",1,2,3", "", ",7") == [[",1,2,3", ",2,3", ",3"], [], [",7"]]
    span = lambda q: lambda x: L.match_span(x, F.lit(q))
    assert [col(spark, span(q), "knjqkkc")[0] for q in ("knj", "njq", "mmm", "")] == [(0, 3), (1, 3), None, None]
    assert col(spark, span("sj"), "knSjq")[0] == (2, 2)
    line = "koie n jwxY qyrw kyqw kyvfu cIrw ]1] rhwau ]"
    assert "".join(L.word_letters(line)) == "knjqkkc"
    assert [L.highlight(line, "knjqkkc", q) for q in ("ਕਨਜ", "ਜਤਕ", "ਮਮਮ", None)] == [(0, 2), (2, 4), None, None]


def test_lexical_search_equals_plain(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("sjkg") for _ in range(rng.randint(0, 30)))) for i in range(200)]
    lines = lexical.encode(spark.createDataFrame(rows, "line_id long, letters string"))
    tokens = lexical.tokens(lines)
    var = {"s": "S", "j": "z", "k": "^", "g": "Z"}
    for q in ("sj", "kkk", "sjkgsjkgsjkgsjkgsj", rows[3][1][:18] or "s", ""):
        alike = {q, "".join(var.get(c, c) for c in q)}
        place = {i: min((t.find(a) for a in alike if a in t), default=-1) for i, t in rows} if q else {}
        want = sorted((len(t), i, place[i]) for i, t in rows if place.get(i, -1) >= 0)[:20]
        assert [(len(r.letters), r.line_id, r.match_pos) for r in lexical.anywhere(tokens, lines, q).collect()] == want
        assert lexical.count_anywhere(tokens, q, lines).first().n == sum(p >= 0 for p in place.values())
        want = sorted((len(t), i) for i, t in rows if q and any(t.startswith(a) for a in alike))[:20]
        assert [(len(r.letters), r.line_id) for r in lexical.start(lines, q).collect()] == want
    with pytest.raises(ValueError):
        lexical.count_anywhere(tokens, "s" * 17)


def test_range_reaches_the_scan(spark, tmp_path):
    lexical.write_tokens(lexical.encode(T.names(spark, SF)), str(tmp_path / "t"), 2)
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = t.filter(lexical.in_ranges("token", "b"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(token" in plan


# ---- text


def test_folds(spark):
    want = "mir ram ih nich karam har mir"
    assert col(spark, X.loose_roman, "mere raam ieh neech karam har mere ||", "mere raam eh neech karam har mere", "mere ram ih nich karam hari mere") == [want.replace("raam", "ram")] * 3 or len(set(col(spark, X.loose_roman, "mere raam ieh neech karam har mere ||", "mere ram ih nich karam hari mere"))) == 1
    assert len(set(col(spark, X.loose_roman, "uootam kahe'eeh a(n)t", "ootam kaheeh ant"))) == 1
    assert col(spark, X.loose_roman, "ਸਤ", None) == ["", ""]
    assert col(spark, X.fold_roman, "Café  NAÏVE-x", None) == ["cafe naive x", ""]
    assert X.indel("kitten", "sitting") == 1 - 5 / 13 and X.indel("", "") == 1 and X.indel("", "a") == 0
    assert col(spark, X.escape_html, "<a b='c'>&\"") == ["&lt;a b=&#x27;c&#x27;&gt;&amp;&quot;"]
    assert col(spark, X.normalize_ip, "", None, "::ffff:1.2.3.4", "::1") == ["unknown", "unknown", "1.2.3.4", "::1"]
    assert col(spark, X.safe_query, "?q=x&k=1", "?q=x", "?a=1&q", "?qq=1") == ["?k=1", "", "?a=1", "?qq=1"]
    assert col(spark, lambda v: X.bounded_int(v, 1, 50, 10), " 7 ", "+99", "-3", "x", None, "1.5", "9" * 16) == [7, 50, 1, 10, 10, 10, 10]
    assert col(spark, X.parse_record_id, "gss-1:0168:1", "Bad:1:1") == [("gss-1", 168, 1), None]
    assert re.fullmatch(X.letter_classes("t o\\"), "Qa\\")


# ---- reading


def test_stanzas(spark):
    ends = [r == 1 for r in col(spark, lambda v: reading.is_stanza_end(v).cast("int"), "x ॥੧॥", "x ॥੪॥੫॥", "x ॥੪॥੬॥੩੯॥ ", "x ॥", "x ॥੧॥ ਰਹਾਉ ॥")]
    assert ends == [True, True, True, False, False]
    cases = {
        1: (["heading", "line", "line", "line", "rahao", "line"], [2], "FFFTTF"),
        2: (["heading", "rahao"], [], "FT"),
        3: (["line", "rahao", "line", "line", "rahao"], [2], "TTFTT"),
    }
    rows = [(g, p, k, "a ॥੧॥" if p in se else "a") for g, (kinds, se, _) in cases.items() for p, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "g long, p int, kind string, t string")
    got = reading.stanza_flags(df, "g", "p", "kind", reading.is_stanza_end(F.col("t"))).orderBy("g", "p").collect()
    for g, (_, _, want) in cases.items():
        assert "".join("T" if r.in_stanza else "F" for r in got if r.g == g) == want


def test_hydrate_keeps_order_and_preferences_skip_empty(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, t string")
    want = spark.createDataFrame([(0, 3), (1, 9), (2, 1)], "ord long, id long")
    assert [r.t for r in reading.hydrate(rows, want, "id").orderBy("ord").collect()] == ["c", "a"]
    texts = spark.createDataFrame([(1, "x", ""), (1, "y", "Y"), (2, "z", "Z")], "id long, s string, t string")
    got = {r.id: (r.tr_en, r.tr_pa) for r in reading.attach_preferred(rows.select("id"), "id", texts.withColumnRenamed("t", "text"), "s", "text", {"en": ["x", "y"], "pa": ["z"]}).collect()}
    assert got == {1: ("Y", None), 2: (None, "Z"), 3: (None, None)}
    nested = reading.nest(rows, "id", spark.createDataFrame([(1, 2, "k"), (1, 1, "j")], "id long, o int, v string"), ["o"], ["o", "v"], "kids").orderBy("id").collect()
    assert [[k.v for k in r.kids] for r in nested] == [["j", "k"], [], []]


def test_pages(spark):
    df = spark.range(45)
    rows, told = catalogue.page(df, [F.asc("id")], 20, 9)
    assert told == {"total": 45, "pages": 3, "page": 3} and [r.id for r in rows.collect()] == list(range(40, 45))
    assert catalogue.page(df.limit(0), [F.asc("id")])[1] == {"total": 0, "pages": 1, "page": 1}
    assert catalogue.letters_mode("abc") and catalogue.letters_mode("a b c") and not catalogue.letters_mode("b sk")
    assert col(spark, lambda v: catalogue.granth_order(v, F.lit(3)), 0, 5, None, kind="int") == [3, 5, 3]


# ---- limits


def test_windows_start_at_the_first_request(spark):
    at = [0, 1, 2, 3, 59_999, 60_000, 60_001]
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate(at)] + [("b", 0, 9)], "c string, t long, i long")
    got = {r.ord: (r.allowed, r.remaining) for r in limits.fixed_window(df, "c", "t", "i", 3, 60_000).collect()}
    assert [got[i] for i in range(7)] == [(True, 2), (True, 1), (True, 0), (False, 0), (False, 0), (True, 2), (True, 1)] and got[9] == (True, 2)
    tight = limits.fixed_window(df, "c", "t", "i", 10, 60_000, F.lit(True), 2).collect()
    assert [r.allowed for r in sorted(tight, key=lambda r: r.ord)][:4] == [True, True, False, False]


@pytest.mark.parametrize(("tight", "expire"), [(None, False), (1, True)])
def test_stream_equals_batch(spark, tmp_path, tight, expire):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else expiry keeps the query alive
    e = T.read(spark, SF, "events").select(F.col("user_id").cast("string").alias("client"), F.col("event_id").alias("ord"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    rules = dict(tight=F.col("event_type") == "click", tight_limit=tight, exempt=F.col("event_type") == "error")
    q = limits.limit_stream(stream, 2, browsing.DAY_US, expire=expire, **rules).writeStream.format("memory").queryName(f"limited{tight}").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted(map(tuple, spark.table(f"limited{tight}").select("ord", "allowed", "remaining").collect()))
    batch = limits.fixed_window(e, "client", "at", "ord", 2, browsing.DAY_US, **rules)
    want = sorted(map(tuple, batch.filter("remaining IS NOT NULL").select("ord", "allowed", "remaining").collect()))
    assert got == want and 0 < len(got) < e.count() == batch.count()


def test_requests_without_a_client_share_a_window(spark):
    df = spark.createDataFrame([(None, 0, 0), (None, 1, 1), (None, 2, 2), (7, 3, 3)], "c long, t long, i long")
    got = sorted((r.ord, r.allowed) for r in limits.fixed_window(df, "c", "t", "i", 1, 60_000).collect())
    assert got == [(0, True), (1, False), (2, False), (3, True)]


def test_client_and_log(spark):
    df = spark.createDataFrame([("http://x/a/b?q=1&k=2#z",)], "u string")
    assert tuple(access_log.log_lines(df, F.col("u")).select("path", "query").first()) == ("/a/b", "?k=2")
    key = lambda h, hops: col(spark, lambda v: limits.client_key(F.lit(h), v, F.lit("9.9.9.9"), hops), "1.1.1.1, 2.2.2.2")[0]
    assert [key(None, 0), key(None, 1), key(None, 2), key(None, 3), key("h", 1)] == ["9.9.9.9", "2.2.2.2", "1.1.1.1", "9.9.9.9", "h"]


# ---- tokenizers


def test_tokenizers(spark):
    assert tok.bert_normalize("Café NAÏVE") == "cafe naive" and tok.bert_normalize("ਸ਼", False, False) == "ਸ਼"
    assert [tok.is_punctuation(c) for c in "!.$।a1€©"] == [True] * 4 + [False] * 4
    w = tok.WordPiece({tok.PAD: 0, tok.UNK: 1, tok.CLS: 2, tok.SEP: 3, "un": 4, "##aff": 5, "##able": 6, ".": 7}, length=6)
    assert w.encode("unaffable.") == [2, 4, 5, 6, 7, 3] and w.encode("unaffable. un") == [2, 4, 5, 6, 7, 3] and w.encode("unx") == [2, 1, 3] and w.encode(None) == [2, 3]
    assert w.pieces("u" * 101) == [tok.UNK]
    u = tok.Unigram([("<unk>", 0.0), ("▁a", -1.0), ("b", -2.0), ("▁ab", -2.5)], bos=10, eos=11, length=4)
    assert u.encode("ab") == [10, 3, 11] and u.encode("a  xyz") == [10, 1, 0, 11] and u.encode("") == [10, 11]
    assert tok.metaspace("a b") == ["▁a", "▁b"] and tok.metaspace("") == [] and tok.nfkc_normalize(" ﬁ​x\x07 ") == "fi x"
    assert tok.pad([[1, 2], [3]]) == ([[1, 2], [3, 0]], [[1, 1], [1, 0]]) and tok.pad([]) == ([], [])
    assert col(spark, lambda v: tok.encode_column(v, w)["ids"], "un", None) == [[2, 4, 3], [2, 3]]
    e = encode.Encoder(pooling="mean")
    assert np.linalg.norm(e.query("some words")) == pytest.approx(1, abs=1e-6) and col(spark, e.column, "some words")[0] == e.query("some words")
    o = encode.Options.of({"model_dir": "m", "pooling": "cls", "max_len": 400, "lowercase": False})
    assert (o.model, o.pooling, o.length, o.lower, o.strip_accents, o.tokenizer) == ("m", "cls", 400, False, True, None)
    other = encode.Options.of({"model_dir": "m", "pooling": "cls", "max_len": 160})
    got = encode.shared({"a": o, "b": other, "c": encode.Options()})
    assert got["a"] == got["b"] and got["a"][1] == 400 and got["c"][1] == 256 and got["c"][0] != got["a"][0]
    assert encode.masked_mean([[1, 2], [3, 4], [9, 9]], [1, 1, 0]) == [2, 3]


# ---- registry and index source


def test_registry(spark, tmp_path):
    for name, m in {"": {"index": "en"}, "copy": {"index": "en"}, "lab": {}, "docs": {"kind": "documents"}}.items():
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / "manifest.json").write_text(json.dumps(m))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "manifest.json").write_text("{")
    found = catalog.discover(str(tmp_path))
    assert [(m or {}).get("index") if m else None for _, m, _ in found] == ["en", None, None, None] and [w is None for _, _, w in found] == [True, False, False, True]
    loaded = {"a": ["text"], "b": ["neighbours"]}
    assert catalog.pick(["a", "b", "z"], loaded, "b,a,a", "text", "a") == ["a"]
    for asked, code in (("z", 503), ("nope", 400), ("b", 400)):
        with pytest.raises(catalog.Refusal) as e:
            catalog.pick(["a", "b", "z"], loaded, asked, "text", "a")
        assert e.value.code == code
    with pytest.raises(ValueError):
        catalog.assert_columns(spark.range(1), ["x"])
    assert catalog.with_optional(spark.range(1), section="string").first().section is None


def test_index_source(spark, tmp_path):
    from granary.sources import qindex

    n, dim = 10, 4
    codes = (np.arange(n * dim) % 100 - 50).astype("i1")
    codes.tofile(tmp_path / "lines.i8")
    np.linspace(0.1, 1, n).astype("<f4").tofile(tmp_path / "lines.scale.f32")
    (np.arange(n) * 10).astype("<i4").tofile(tmp_path / "lines.ids.i32")
    (np.arange(n) % 2).astype("u1").tofile(tmp_path / "lines.mask.u8")
    (tmp_path / "manifest.json").write_text(json.dumps({"index_dim": dim, "embed_dim": 3}))
    np.array([0.5, np.nan], "<f4").tofile(tmp_path / "agreement.en.f32")
    qindex.register(spark)
    for at in (str(tmp_path), f"file://{tmp_path}"):
        rows = spark.read.format("qindex").option("rows", 3).load(at).orderBy("row").collect()
        assert [r.id for r in rows] == [i * 10 for i in range(n)] and rows[3].codes == codes[12:16].tolist() and [r.mask for r in rows[:2]] == [False, True]
    assert list(map(tuple, spark.read.format("qagreement").load(str(tmp_path)).collect())) == [("en", 0, 0.5)]
    for bad in (("lines", 3), ("shabads", 3)):
        with pytest.raises(ValueError):
            qindex.Reader(str(tmp_path), *bad, 5)
    for name in qindex.CORPUS:
        with pytest.raises(ValueError, match=name):
            qindex.Reader(str(tmp_path), "units", None, 5, "corpus")
        {"units.i8": codes, "units.scale.f32": np.ones(n, "<f4"), "units.mask.u8": np.ones(n, "u1"), "pca.components.f32": np.arange(12, dtype="<f4"), "pca.mean.f32": np.ones(3, "<f4")}[name].tofile(tmp_path / name)
    assert spark.read.format("qindex").option("kind", "corpus").load(str(tmp_path)).count() == n
    parts, mean = qindex.projection(str(tmp_path))
    assert parts[1] == [3, 4, 5] and len(parts) == 4 and mean == [1, 1, 1]


def test_files_of_a_pack(spark, tmp_path):
    import hashlib

    from granary.sources import packs

    for name, body in (("a.bin", b"one"), ("b.bin", b"two"), ("c.bin", b"three")):
        (tmp_path / name).write_bytes(body)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = spark.createDataFrame([("a.bin", sha(b"one").upper(), 3), ("b.bin", sha(b"2"), 3), ("c.bin", sha(b"three"), 4), ("d.bin", "", 0)], "name string, sha256 string, bytes long")
    assert {r.name: r.state for r in packs.verified(spark, str(tmp_path), listed).collect()} == {"a.bin": "ok", "b.bin": "digest", "c.bin": "size", "d.bin": "missing"}


# ---- notation


def test_notation_text_round_trip():
    rec, taals = records.RECORD, records.TAALS
    assert render.text(rec, taals) == "[sthai 1]\nS R G | M P D ||\n  a b . d e f"
    assert render.parse_cell("{P'}m~-") == {"notes": [{"s": "M", "t": True, "kan": {"s": "P", "o": 1}, "kh": True, "len": 2}], "div": 2}
    for line in ("S R' g, | {G}M~-- * ||", "@3 S - ? n ||", "SR m'"):
        p = render.parse_line(line)
        beats = [b | {"m": i + p["matra_from"]} for i, b in enumerate(p["beats"])]
        back = next(iter(render.grid({"heading": {"taal": {"key": "dadra"}}, "sections": [{"kind": "sthai", "lines": [p | {"beats": beats}]}]}, taals)))
        assert render.line_text(back).replace("| ", "") == line.replace("| ", "")
    with pytest.raises(ValueError):
        render.parse_cell("Q")
    assert len(render.word_spans("ਸਤਿ ਨਾਮੁ ॥੧॥ ਰਹਾਉ ॥ ਕਰਤਾ")) == 3
    page = render.html(rec, taals, script=render.Script({c: c.lower() for c in "SRGMPDN"}))
    assert 'data-id="book:0042:3" data-script="gurmukhi"' in page and '<span class="n" data-s="M">m</span>' in page and page.count("<table") == 1
    odd = {"sections": [{"kind": "sthai", "lines": [{"kind": "free", "beats": [{"notes": None, "raw": "<"}, {"notes": [{"s": "S", "len": 2, "kan": {"s": "R"}, "kh": True}, {"s": "G"}], "bol": {"g": "a", "h": 2}}]}]}]}
    page = render.html(odd, taals)
    assert '<span class="n n-unknown" title="&lt;">?</span>' in page and '<sup class="n-kan">R</sup><span class="n n-khatka n-len-2" data-s="S">S</span>-' in page and 'a<span class="b-held">--</span>' in page


def test_notation_defaults_and_hash():
    rec = {"sections": [{"lines": [{"beats": [{"notes": [{"s": "S", "o": 0, "kan": {"s": "R"}}]}]}]}]}
    full = notation.fill_defaults(rec)
    note = full["sections"][0]["lines"][0]["beats"][0]["notes"][0]
    assert note["len"] == 1 and "len" not in note["kan"] and full["sections"][0]["lines"][0]["matra_from"] == 1
    assert notation.strip_defaults(full) == {"sections": [{"lines": [{"beats": [{"notes": [{"s": "S", "kan": {"s": "R"}}]}]}]}]}
    assert notation.canonical_json({"b": 1, "a": [{"d": 2, "c": 3}]}) == '{"a":[{"c":3,"d":2}],"b":1}'
    assert notation.content_hash(rec) == notation.content_hash(full)


def test_vocabulary_ladder(spark):
    rows = [("sarang", "sarang"), ("brindavani_sarang", "brindavani sarang"), ("gauri", "gauri"), ("bhairavi", "bhairavi"), ("bhairav", "bhairav")]
    v = vocab.Vocabulary(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, key string, spelling string"), stops=("raag",))
    asked = spark.createDataFrame([(0, "Raag Sarang (Brindavani Sarang)"), (1, "GAURI!"), (2, "gaura"), (3, "sarangg x"), (4, "zzzz"), (5, None)], "ord int, text string")
    got = {r.text: (r.key, r.method) for r in v.lookup(asked, "text", 0.85).collect()}
    assert got["GAURI!"] == ("gauri", "alias") and got["zzzz"] == (None, "none") and got[None] == (None, "none")
    parents = spark.createDataFrame([("gauri", None)], "key string, parent string")
    found = {r.ord: (r.key, r.parent, r.method) for r in vocab.normalise_raag(v, asked, parents, 0.85).collect()}
    assert found[0] == ("brindavani_sarang", "sarang", "alias")
    assert vocab.section_label("ਅੰਤਰਾ ੨", {"antara": ["ਅੰਤਰਾ"]}) == ("antara", 2) and vocab.section_label("x", {"antara": ["y"]}) is None


# ---- registered queries

SAME = list(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import os

    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", SAME)
def test_queries_equal_their_sql(spark, duck, name):
    import __spark_entry__ as entry

    a = entry.queries()[name](spark, SF).toPandas()
    b = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    tidy = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).itertuples(index=False, name=None)))
    assert tidy(a) == tidy(b)


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
