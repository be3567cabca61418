"""Kept tables follow their sources, and never lie where only one machine sees them."""

import os
from types import SimpleNamespace

import pytest

from granary.plans import tables
from granary.sources import store


def write(spark, rows, path, mode="append"):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.partitionBy("lang").mode(mode).parquet(path)


def test_a_folder_that_grows_is_met_anew(spark, tmp_path):
    at = f"{tmp_path}/documents.parquet"
    write(spark, [(1, "a b\nc", "en")], at)
    assert tables.lines(spark, str(tmp_path)).count() == 2
    before = store.state(spark, at)
    write(spark, [(2, "d", "en")], at)  # a file more in a folder below: the top folder looks as before
    assert store.state(spark, at) != before
    assert sorted(r.line for r in tables.lines(spark, str(tmp_path)).collect()) == ["a b", "c", "d"]
    assert tables.tokens(spark, str(tmp_path)).count() == 4


def test_what_is_replaced_goes_after_a_day(spark, tmp_path, monkeypatch):
    source = f"{tmp_path}/s.parquet"
    spark.range(3).write.parquet(source)
    made = lambda: store.kept(spark, "replaced", 1, [source], lambda: spark.read.parquet(source))
    names = lambda: {n for n in os.listdir(f"{store.folder(spark)}/granary-store".removeprefix("file:")) if n.startswith("replaced-")}
    assert made().count() == 3
    (first,) = names()
    spark.range(4).write.mode("append").parquet(source)
    assert made().count() == 7 and first in names()
    monkeypatch.setattr(store, "GRACE", -60)
    spark.range(1).write.mode("append").parquet(source)
    assert made().count() == 8 and len(names()) == 1


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda k, d=None: d)
    for master in ("spark://x:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        with pytest.raises(ValueError, match="share"):
            store.folder(SimpleNamespace(sparkContext=context, conf=conf))
    named = SimpleNamespace(get=lambda k, d=None: "s3a://b/x" if k == "spark.checkpoint.dir" else d)
    assert store.folder(SimpleNamespace(sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None), conf=named)) == "s3a://b/x"


def test_a_group_too_long_for_its_ids_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "LINES_A_GROUP", 4)
    write(spark, [(1, "a\nb\nc\nd\ne", "en")], f"{tmp_path}/documents.parquet")
    with pytest.raises(Exception, match="more than 4 lines"):
        tables.raw_lines(spark, str(tmp_path)).select("line_id").collect()
