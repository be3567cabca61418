"""Index files written by tasks and read in ranges; what fails leaves nothing behind; a corpus' tables."""

import os
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.sources import qindex


def index(spark, n, dim=5):
    rng = np.random.default_rng(n)
    rows = [(i, int(rng.integers(-9, 2**31 - 1)), rng.integers(-127, 128, dim).tolist(), float(np.float32(rng.random())), bool(rng.integers(2))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "row long, id long, codes array<tinyint>, scale float, mask boolean")


@pytest.mark.parametrize("n", [1, 7, 3000])
def test_whole_files_from_ranges(spark, tmp_path, n):
    rows, df = index(spark, n)
    qindex.write(df.repartition(5), f"{tmp_path}/x", manifest={"index_dim": 5}, parts=4)
    assert sorted(os.listdir(f"{tmp_path}/x")) == ["lines.i8", "lines.ids.i32", "lines.mask.u8", "lines.scale.f32", "manifest.json"]
    assert np.fromfile(f"{tmp_path}/x/lines.i8", "i1").reshape(n, 5).tolist() == [r[2] for r in rows]
    back = spark.read.format("qindex").option("rows", 100).load(f"{tmp_path}/x").orderBy("row").collect()
    assert [tuple(r) for r in back] == rows


@pytest.mark.parametrize(("bad", "said"), [("if(row < 40, row, row + 1)", "missing|in order"), ("row % 49", "missing|in order|twice")])
def test_gaps_and_repeats_leave_no_part(spark, tmp_path, bad, said):
    _, df = index(spark, 50)
    with pytest.raises(Exception, match=said):
        qindex.write(df.withColumn("row", F.expr(bad)), f"{tmp_path}/x", manifest={"index_dim": 5}, parts=3)
    assert os.listdir(f"{tmp_path}/x") == []


def test_a_failing_task_leaves_no_part(spark, tmp_path):
    _, df = index(spark, 3000)
    broken = df.withColumn("id", F.when(F.col("row") == 2500, F.lit(2**31)).otherwise(F.col("id")))
    with pytest.raises(Exception, match="32 bits"):
        qindex.write(broken, f"{tmp_path}/x", manifest={"index_dim": 5}, parts=3)
    assert os.listdir(f"{tmp_path}/x") == []


def test_agreement_in_ranges(spark, tmp_path):
    x = np.linspace(-1, 1, 1000, dtype="<f4")
    x[::7] = np.nan
    x.tofile(f"{tmp_path}/agreement.en.f32")
    x[:10].tofile(f"{tmp_path}/agreement.fr.f32")
    qindex.register(spark)
    got = spark.read.format("qagreement").option("rows", 64).load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 17
    want = sorted((a, i, float(v)) for a, n in (("en", 1000), ("fr", 10)) for i, v in enumerate(x[:n]) if np.isfinite(v))
    assert sorted(map(tuple, got.collect())) == want


def test_tables_of_a_corpus(spark, tmp_path):
    with sqlite3.connect(f"{tmp_path}/corpus.sqlite") as db:
        db.execute("CREATE TABLE units (unit_row INTEGER, work_id TEXT, text TEXT)")
        db.execute("CREATE TABLE citations (unit_row INTEGER, score REAL)")
        db.executemany("INSERT INTO units VALUES (?, ?, ?)", [(i, f"w{i % 3}", f"é {i}" if i % 5 else None) for i in range(5000)])
        db.execute("DELETE FROM units WHERE unit_row BETWEEN 100 AND 2999")
    db.close()
    qindex.register(spark)
    units = spark.read.format("qcorpus").option("rows", 500).load(str(tmp_path))
    assert units.schema.simpleString() == "struct<ord:bigint,unit_row:bigint,work_id:string,text:string>" and units.rdd.getNumPartitions() == 10
    assert sorted(tuple(r)[1:] for r in units.collect()) == [(i, f"w{i % 3}", f"é {i}" if i % 5 else None) for i in [*range(100), *range(3000, 5000)]]
    assert spark.read.format("qcorpus").option("table", "citations").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="no table"):
        spark.read.format("qcorpus").option("table", "works").load(str(tmp_path)).count()
