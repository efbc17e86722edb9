"""A store of many small runs, written in batches."""

import test_store
from pyspark.sql import functions as F

from ionframe import schemas
from ionframe.sources import tables


def shown(spark, path):
    rows = tables.read_runs(spark, path, batches=True).groupBy("run_id").agg({"intensity": "sum", "mz": "count"}).collect()
    return {r["run_id"]: (r["count(mz)"], r["sum(intensity)"]) for r in rows}


def add(spark, path, runs, intensity, n=20, **options):
    tables.add_runs(test_store.peaks(spark, runs, intensity, n), path, batches=True, **options)


def test_runs_are_added_and_replaced_whole(spark, tmp_path):
    path = tmp_path / "store"
    add(spark, str(path), ["007", "7", "a/b=c d", "", None], 1.0)
    before = test_store.files(path)
    add(spark, str(path), ["other", "7"], 2.0, n=8)
    both = {"007": (20, 20.0), "7": (8, 16.0), "a/b=c d": (20, 20.0), "": (20, 20.0), None: (20, 20.0), "other": (8, 16.0)}
    assert shown(spark, str(path)) == both
    assert before.items() <= test_store.files(path).items()
    add(spark, str(path), [None], 3.0, n=1)
    add(spark, str(path), ["none"], 3.0, n=0)
    assert shown(spark, str(path)) == {**both, None: (1, 3.0)}
    assert tables.read_runs(spark, str(path), batches=True).schema == schemas.LONG


def test_a_first_call_without_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    add(spark, path, ["a"], 1.0, n=0)
    assert shown(spark, path) == {}
    for _ in range(2):
        add(spark, path, ["a"], 1.0)
    assert shown(spark, path) == {"a": (20, 20.0)}


def test_a_batch_cut_short_is_not_read(spark, tmp_path):
    path = str(tmp_path / "store")
    add(spark, path, ["a"], 1.0)
    schemas.conform(test_store.peaks(spark, ["a", "b"], 5.0), schemas.LONG).write.parquet(f"{path}/batch=000000000009-x")
    assert shown(spark, path) == {"a": (20, 20.0)}


def test_files_do_not_grow_with_the_runs(spark, tmp_path):
    path = tmp_path / "store"
    rows = spark.range(3000).select(F.concat(F.lit("run="), F.col("id") % 1000).alias("run_id"), F.col("id").cast("string").alias("id"))
    tables.add_runs(rows.withColumn("rt", F.lit(1.0)), str(path), batches=True)
    assert len(test_store.files(path)) <= 16
    assert tables.read_runs(spark, str(path), batches=True).count() == 3000


def test_documents_and_index(spark, tmp_path):
    path = str(tmp_path / "store")
    document = lambda runs, text: spark.createDataFrame([(r, text) for r in runs], "run_id string, document string")
    add(spark, path, ["a", "b"], 1.0, documents=document(["a", "b"], "old"), index=True)
    add(spark, path, ["b"], 1.0, n=2, documents=document(["b"], "new"), index=True)
    assert {r.run_id: r.document for r in tables.read_documents(spark, path, batches=True).collect()} == {"a": "old", "b": "new"}
    assert {r.run_id: r["count"] for r in tables.read_index(spark, path, batches=True).groupBy("run_id").count().collect()} == {"a": 4, "b": 2}
