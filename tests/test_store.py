"""A store that runs are added to."""

import pytest

from ionframe import schemas
from ionframe.sources import tables

COLUMNS = "run_id string, id string, data_type string, ms_level byte, rt float, mz float, intensity float, extra int, _band int"


def peaks(spark, runs, intensity, n=20):
    rows = [(r, f"scan={i % 4}", "spectrum", 1, float(i % 4), 100.0 + i, intensity, 1, 2) for r in runs for i in range(n)]
    return spark.createDataFrame(rows, COLUMNS)


def shown(spark, path):
    rows = tables.read_runs(spark, path).groupBy("run_id").agg({"intensity": "sum", "mz": "count"}).collect()
    return {r["run_id"]: (r["count(mz)"], r["sum(intensity)"]) for r in rows}


def files(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_runs_are_added_and_replaced_whole(spark, tmp_path):
    path = tmp_path / "store"
    odd = ["007", "7", "a/b=c d", None]
    tables.add_runs(peaks(spark, odd, 1.0), str(path))
    before = files(path)
    tables.add_runs(peaks(spark, ["other", "7"], 2.0, n=8), str(path))
    assert shown(spark, str(path)) == {"007": (20, 20.0), "7": (8, 16.0), "a/b=c d": (20, 20.0), None: (20, 20.0), "other": (8, 16.0)}
    # What was not written again is still the same files.
    after = files(path)
    assert {f: t for f, t in before.items() if "run_id=7/" not in f}.items() <= after.items()
    tables.add_runs(peaks(spark, [None], 3.0, n=1), str(path))
    assert shown(spark, str(path))[None] == (1, 3.0)
    assert tables.read_runs(spark, str(path)).schema == schemas.LONG


def test_the_same_call_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    for _ in range(2):
        tables.add_runs(peaks(spark, ["a", "b"], 1.0).withColumnRenamed("extra", "RUN"), path)
    assert shown(spark, path) == {"a": (20, 20.0), "b": (20, 20.0)}


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "store")
    tables.add_runs(peaks(spark, ["a"], 1.0).limit(0), path)
    assert shown(spark, path) == {}
    tables.add_runs(peaks(spark, ["a"], 1.0), path)
    tables.add_runs(peaks(spark, ["a"], 1.0).limit(0), path)
    assert shown(spark, path) == {"a": (20, 20.0)}


def test_a_run_filter_opens_its_folder_only(spark, tmp_path):
    path = str(tmp_path / "store")
    tables.add_runs(peaks(spark, ["a", "b", "c"], 1.0), path)
    found = tables.read_runs(spark, path).where("run_id = 'b'")
    assert "PartitionFilters: [isnotnull(run_id" in found._jdf.queryExecution().toString().replace("\n", "")
    assert found.count() == 20


@pytest.mark.parametrize("again", [False, True])
def test_documents_come_with_their_runs(spark, tmp_path, again):
    path = str(tmp_path / "store")
    document = lambda runs, text: spark.createDataFrame([(r, text) for r in runs], "run_id string, document string")
    tables.add_runs(peaks(spark, ["a", "b"], 1.0), path, documents=document(["a", "b"], "old"))
    if again:
        tables.add_runs(peaks(spark, ["b"], 1.0), path, documents=document(["b"], "new"))
    found = {r.run_id: r.document for r in tables.read_documents(spark, path).collect()}
    assert found == {"a": "old", "b": "new" if again else "old"}
