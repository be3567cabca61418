"""Running counts and sums, and joins with hot groups, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from granary.operators.scan import filled, hold, in_ranges, joined, running


@pytest.mark.parametrize("n", [1, 3, 40])
def test_running_over_ranges(spark, n, tmp_path):
    rng = random.Random(n)
    rows = [(rng.choice([None, 1, 1, 1, 1, 1, 2, 3, -4]), i, rng.choice([None, 5, -2, 10**12])) for i in range(2500)]
    at = f"{tmp_path}/checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    held = in_ranges(spark.createDataFrame(rows, "k long, o long, x long").repartition(7), n, "k", ["o"]).checkpoint()
    assert held.rdd.getNumPartitions() == n
    got = {(r.k, r.o): (r.rank, r.running_x) for r in running(held, "k", ["x"]).collect()}
    want, state = {}, {}
    for k, o, x in sorted(rows, key=lambda r: r[1]):
        place, total = state.get(k, (0, 0))
        want[k, o] = (place, total + (x or 0))
        state[k] = (place + 1, total + (x or 0))
    assert got == want
    assert running(in_ranges(held.limit(0), 2, "k", ["o"]).checkpoint(), "k").count() == 0


def test_joined_with_a_hot_group(spark):
    rows = spark.range(9000).select(F.when(F.col("id") < 6000, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).filter("k <> 7")
    out = joined(rows, groups, ["k"], "n", 9000)
    want = rows.join(groups, "k")
    assert sorted(map(tuple, out.select("k", "id", "n", "least").collect())) == sorted(map(tuple, want.select("k", "id", "n", "least").collect()))


@pytest.mark.parametrize("n", [1, 3, 30])
def test_filled_over_ranges(spark, n):
    rng = random.Random(n + 7)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 9]), i, rng.choice([None] * 30 + ["a", "b", ""])) for i in range(2000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        held = hold(in_ranges(spark.createDataFrame(rows, "k long, o long, x string").repartition(5), n, "k", [F.desc("o")]))
        got = {(r.k, r.o): r.y for r in filled(held, "k", "x", "y").collect()}
        ranks = {(r.k, r.o): r.rank for r in running(held, "k").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, places, state, place = {}, {}, {}, {}
    for k, o, x in sorted(rows, key=lambda r: -r[1]):
        state[k] = x if x is not None else state.get(k)
        place[k] = place.get(k, -1) + 1
        want[k, o], places[k, o] = state[k], place[k]
    assert got == want and ranks == places


def test_stanzas_of_a_group_larger_than_a_task(spark):
    from granary.operators import reading

    rng = random.Random(2)
    rows = [(1 if i < 3000 else 2 + i % 3, i, rng.choices(["line", "rahao", "heading"], [20, 1, 1])[0], rng.random() < 0.02) for i in range(4000)]
    df = spark.createDataFrame(rows, "g long, p long, kind string, brk boolean")
    flags = lambda d: sorted((r.g, r.p, r.in_stanza) for r in d.collect())
    assert flags(reading.stanza_flags_in_ranges(df, "g", ["p"], "kind", F.col("brk"), 13)) == flags(reading.stanza_flags(df, "g", "p", "kind", F.col("brk")))


def test_neighbours_of_many_queries_are_one_job(spark):
    from granary.operators import vectors

    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    index = vectors.build_index(spark.createDataFrame(rows, "id long, v array<double>").repartition(6), "id", "v")
    asked = index.select(F.col("id").alias("qid"), F.col("row").alias("qrow"), vectors.dequantize(F.col("codes"), F.col("scale")).alias("q"))
    told = lambda **kw: sorted(map(tuple, vectors.neighbours_batch(index, asked, 3, **kw).collect()))
    whole = told()
    assert len(whole) == 1200 and told(block=7) == whole and told(sent=5_000) == whole
    found = vectors.neighbours_batch(index, asked, 3)
    assert "parquet" not in found._jdf.queryExecution().executedPlan().toString().lower()


def test_counts_by_bitmaps_equal_counts_by_tokens(spark):
    from granary.operators import lexical

    rng = random.Random(6)
    letters = ["".join(rng.choice("gjsKPzab") for _ in range(rng.randrange(9))) for _ in range(40_000)]
    lines = lexical.encode(spark.createDataFrame([(10 * i, x) for i, x in enumerate(letters)], "line_id long, letters string"))
    numbered = lines.withColumn("number", (F.col("line_id") / 10).cast("long"))
    asked = spark.createDataFrame([(a + b,) for a in "gjsKab" for b in "gsPbq"], "keys string")
    told = lambda d: sorted((r["keys"], r["n"]) for r in d.collect())
    bits = lexical.postings(numbered).checkpoint()
    assert bits.agg(F.max("bucket")).first()[0] >= 1
    assert told(lexical.count_postings(bits, asked)) == told(lexical.count_batch(lexical.tokens(lines), asked, 2))
    assert lexical.count_postings(bits, asked.limit(0)).count() == 0
