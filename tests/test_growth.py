"""Queries whose work must grow with their input alone: needs by many ways, clients beyond a bound, lines without kept tables."""

import random

import pytest
from pyspark.sql import functions as F


def test_needs_by_very_many_ways_are_followed_once(spark):
    from granary.sources import packs

    n = 45  # a pack needs the two before it: some 10^9 ways lead from the last to the first
    needs = spark.createDataFrame([(i, i - k) for i in range(n) for k in (1, 2) if i >= k] + [(0, 7), (900, 901)], "pack long, needs long")  # 0 needs 7: a circle
    asked = spark.createDataFrame([(n - 1,), (n - 1,), (-3,)], "pack long")
    assert sorted(r.pack for r in packs.required(asked, needs).collect()) == [-3, *range(n)]
    assert packs.required(asked.limit(0), needs).count() == 0


def test_limits_of_a_stream_may_forget_no_client(spark, tmp_path):
    from granary.streaming import limits

    rows = [(f"c{i % 150}", i, i) for i in range(600)]
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for lot in range(2):
            spark.createDataFrame(rows[300 * lot : 300 * lot + 300], "client string, ord long, at long").write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema("client string, ord long, at long").parquet(f"{tmp_path}/in")
            told = limits.limit_stream(stream, 3, 10**9, expire=False, most=None, buckets=2)
            assert told.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.unset(store)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(out) == 600 and all(r.allowed == (r.ord < 450) for r in out)  # the fourth request of each is refused


def test_search_in_lines_equals_search_by_tokens_and_shuffles_no_line(spark):
    from granary.operators import lexical

    rng = random.Random(3)
    pool = ["gjsKPzZS^&ab", "st", "ab1ਕ+é"]
    letters = ["".join(rng.choice(pool[i % 3]) for _ in range(rng.choice([0, 1, 3, 8, 40]))) for i in range(900)]
    lines = lexical.encode(spark.createDataFrame([(10 * i, x) for i, x in enumerate(letters)], "line_id long, letters string")).cache()
    tokens = lexical.tokens(lines).cache()
    told = lambda d: [(r.line_id, r.letters, r.match_pos) for r in d.collect()]
    for q in ("s", "gj", "zZ", "b+", "a1", "é", "ਕ", "", "st" * 9, "s" * 17, "jg"):
        assert told(lexical.anywhere_in_lines(lines, q, None)) == told(lexical.anywhere(tokens, lines, q, None)), q
        assert told(lexical.start_in_lines(lines, q, 30)) == told(lexical.start(lines, q, 30)), q
        assert lexical.count_in_lines(lines, q).first().n == lexical.count_anywhere(tokens, q, lines).first().n, q
    assert told(lexical.anywhere_in_lines(lines, "gj", 7)) == told(lexical.anywhere(tokens, lines, "gj", 7))


def test_counts_in_lines_equal_counts_by_tokens(spark):
    from granary.operators import lexical

    rng = random.Random(6)
    lines = lexical.encode(spark.createDataFrame([(i, "".join(rng.choice("gjsKPzZS^&ab") for _ in range(rng.randrange(9)))) for i in range(3000)], "line_id long, letters string"))
    asked = spark.createDataFrame([(a + b,) for a in "gjsKazZ" for b in "gsPbqS&"], "keys string")
    told = lambda d: sorted((r["keys"], r["n"]) for r in d.collect())
    assert told(lexical.count_batch_in_lines(lines, asked, 2)) == told(lexical.count_batch(lexical.tokens(lines), asked, 2))
    assert lexical.count_batch_in_lines(lines, asked.limit(0), 2).count() == 0


@pytest.mark.parametrize("name", ["fl_anywhere", "fl_anywhere_variant", "fl_anywhere_long", "fl_count_variant", "fl_start", "bert_words", "letters_by_sound", "lines_hydrate", "catalog_native", "match_lines", "fl_count_batch"])
def test_lines_are_read_from_the_documents_and_keep_no_table(spark, name, tmp_path):
    import __spark_entry__ as entry

    from granary.sources import store

    spark.conf.set(store.SETTING, str(tmp_path))
    try:
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(store.SETTING)
    assert "documents.parquet" in plan and not list(tmp_path.iterdir())


def test_tiles_of_neighbours_are_bounded_and_keep_ties(spark, monkeypatch):
    from granary.operators import vectors

    rng = random.Random(5)
    rows = [(i, [float(rng.choice([-1, 0, 1])) for _ in range(4)]) for i in range(300)]  # many equal scores
    index = vectors.build_index(spark.createDataFrame(rows, "id long, v array<double>").repartition(3), "id", "v")
    asked = index.select(F.col("id").alias("qid"), F.col("row").alias("qrow"), vectors.dequantize(F.col("codes"), F.col("scale")).alias("q"))
    told = lambda **kw: sorted(map(tuple, vectors.neighbours_batch(index, asked, 3, **kw).collect()))
    want = sorted((r.qid, r.rank, r.id, r.score) for r in vectors.similar_many(index, list(range(300)), 3).collect())
    assert vectors.TILE_ROWS * vectors.BATCH_QUERIES * 8 <= 32 << 20
    for tile in (2, 3, 7, 1024):
        monkeypatch.setattr(vectors, "TILE_ROWS", tile)
        assert told(block=50) == want


def test_fingerprints_link_in_the_near_dedup_stage(spark):
    import corpus_pipeline

    from granary.llm import simhash

    # one shingle of three words repeated: the same fingerprint, while shingles of five words differ by their edits
    base = " ".join(["alpha beta gamma"] * 60)
    texts = {1: base, 2: base + " delta", 3: "other words stand here alone", 4: None}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    linked = {r.doc_id: r.component_id for r in simhash.near_duplicates(d).collect()}
    exact = {r.doc_id: r.component_id for r in simhash.near_copies(d, similarity=0.8).collect()}
    assert linked[2] == 1 and exact[2] == 2
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, d, "").collect()) == [1, 3, 4]


def test_near_dedup_stage_makes_two_graphs(spark, monkeypatch):
    """The driver holds the plans of every round; links by fingerprints and by similarity share their rounds."""
    import corpus_pipeline

    from granary.llm import graph, near_copies, simhash

    made, plain = [], graph.components
    for module in (graph, near_copies, simhash):
        monkeypatch.setattr(module, "components", lambda edges: made.append(1) or plain(edges), raising=False)
    # 1 and 2 share nearly all shingles of five words, 3 and 4 the fingerprint
    base, more = " ".join(["alpha beta gamma"] * 60), " ".join(f"w{i}" for i in range(40))
    texts = {1: f"{more} x", 2: f"{more} y", 3: base, 4: f"{base} delta", 5: None, 6: ""}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, d, "").collect()) == [1, 3, 5]
    assert len(made) == 2


def test_records_are_parsed_once_for_the_rules_of_a_row(spark):
    from granary.operators import notation

    d = spark.createDataFrame([(1, '{"sections": []}'), (2, "no record")], "id long, body string")
    raags, taals = spark.createDataFrame([("r",)], "key string"), spark.createDataFrame([("t", 4)], "key string, matras int")
    plan = notation.validate(d, "id", "body", raags, taals)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") <= 8  # 4 levels once, sections and beats again for what stands before
