"""Streams with bounded state and exact sinks: what is evicted, what a restart repeats, what the timer sweeps."""

import json
import time

import pytest
from pyspark.sql import functions as F

from granary.streaming import access_log, limits

SCHEMA = "client string, ord long, at long"


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def arrive(spark, rows, at, files=1):
    spark.createDataFrame(rows, SCHEMA).repartitionByRange(files, "ord").write.mode("append").parquet(f"{at}/in")


def run(spark, at, change=lambda x: x, trigger=None, **how):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    told = limits.limit_stream(change(stream), buckets=2, **({"expire": False} | how))
    out = told.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/ck").outputMode("append")
    return out.trigger(**(trigger or {"availableNow": True})).start()


def held(spark, at):
    return spark.read.format("statestore").option("stateVarName", "windows").load(f"{at}/ck").count()


def test_windows_forget_what_is_over_then_the_first_met():
    w = limits.Windows(limits.Rule(2, 100), 3, {})
    for at, c in enumerate(["a", "b", "c", "a"]):
        w.request(c, at, False)
    assert w.request("a", 5, False) == (False, 0) and list(w.held) == ["a", "b", "c"]
    assert w.request("d", 6, False) == (True, 1) and list(w.held) == ["b", "c", "d"]
    assert w.request("a", 7, False) == (True, 1) and list(w.held) == ["c", "d", "a"]  # forgotten, so it begins anew
    w.request("e", 104, False)  # c's window is over, those of d and a are not
    assert list(w.held) == ["d", "a", "e"]
    again = limits.Windows(limits.Rule(2, 100), 3, dict(reversed(w.held.items())), w.place)
    assert list(again.held) == ["d", "a", "e"]


def test_state_stays_within_its_bound(spark, tmp_path):
    rows = [(f"c{i % 150}", i, i) for i in range(600)]
    for k in range(0, 600, 200):
        arrive(spark, rows[k : k + 200], tmp_path)
        assert run(spark, tmp_path, limit=5, window_us=10**9, most=20).awaitTermination(120)
        assert 0 < held(spark, tmp_path) <= 20
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.ord for r in out) == list(range(600)) and all(r.allowed for r in out)  # each client was forgotten before it came again


def test_a_failed_stream_loses_and_doubles_nothing(spark, tmp_path):
    rows = [(None if i % 7 == 0 else f"c{i % 11}", i, i) for i in range(400)]
    for k in range(0, 400, 100):
        arrive(spark, rows[k : k + 100], tmp_path)
    broken = lambda s: s.withColumn("at", F.when(F.col("ord") == 250, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("at")))
    with pytest.raises(Exception, match="lost|STREAM"):
        run(spark, tmp_path, broken, limit=3, window_us=90).awaitTermination(120)
    part = spark.read.parquet(f"{tmp_path}/out").count()
    assert 0 < part < 400
    assert run(spark, tmp_path, limit=3, window_us=90).awaitTermination(120)
    got = sorted((r.ord, r.allowed, r.remaining) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = limits.fixed_window(spark.createDataFrame(rows, SCHEMA), "client", "at", "ord", 3, 90)
    assert got == sorted((r.ord, r.allowed, r.remaining) for r in want.collect())
    assert run(spark, tmp_path, limit=3, window_us=90).awaitTermination(120) and spark.read.parquet(f"{tmp_path}/out").count() == 400


def test_the_timer_sweeps_what_is_over(spark, tmp_path):
    arrive(spark, [(f"c{i}", i, i * 100_000) for i in range(40)], tmp_path)  # windows of 0.3 s, so all but the last few are over
    q = run(spark, tmp_path, trigger={"processingTime": "300 milliseconds"}, limit=3, window_us=300_000, expire=True)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    try:
        end = time.time() + 60
        while time.time() < end and not (q.lastProgress and q.lastProgress["batchId"] >= 1):
            time.sleep(0.5)
        arrive(spark, [("late", 99, 40 * 100_000)], tmp_path)
        while time.time() < end and q.lastProgress["batchId"] < 4 and (not q.lastProgress["numInputRows"] or q.lastProgress["batchId"] < 1):
            time.sleep(0.5)
        q.processAllAvailable()
    finally:
        q.stop()
    assert 0 < held(spark, tmp_path) <= 10


@pytest.mark.parametrize("form", ["json", "text"])
def test_access_log_lines_are_written_once(spark, tmp_path, form):
    urls = [f"https://h/p{i}?a=1&q=secret{i}" if i % 3 else f"/p{i}?q=x\ny" for i in range(60)]
    for k in (0, 30):
        spark.createDataFrame(list(enumerate(urls))[k : k + 30], "i long, u string").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("i long, u string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        assert access_log.log_sink(stream, F.col("u"), f"{tmp_path}/out", f"{tmp_path}/ck", form=form, i=F.col("i")).awaitTermination(120)
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert len(lines) == 60 and not any("secret" in x for x in lines)
    paths = [json.loads(x)["path"] for x in lines] if form == "json" else [x.split(" ")[1] for x in lines]
    assert sorted(paths) == sorted(f"/p{i}" for i in range(60))
    with pytest.raises(ValueError):
        access_log.log_sink(stream, F.col("u"), "x", "y", form="xml")
