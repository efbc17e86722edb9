"""Spectra fetched by the index of a store."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ionframe import schemas
from ionframe.operators import extract
from ionframe.sources import tables


def long_table(spark, n_runs=6, n_scans=40):
    """Runs whose scans have several peaks each, odd names, null and NaN among the keys, and chromatograms."""
    rng = random.Random(3)
    rows = []
    for r in [*(f"run={i}" for i in range(n_runs)), "", "Z\u00e9", None]:
        for s in range(n_scans):
            level, rt = (None if s == 7 else s % 3 + 1), (None if s == 8 else math.nan if s == 9 else float(s * 30))
            rows += [(r, f"scan={s}", "spectrum", level, rt, rng.uniform(100, 900), 1.0, None, k) for k in range(6)]
        rows.append((r, "scan=1", "chromatogram", None, 1.0, 5.0, 1.0, None, 0))
    rows.append(("run=0", None, "spectrum", 1, 5.0, 5.0, 1.0, None, 0))
    # Peaks of one spectrum that differ in level and RT.
    rows += [("run=1", "scan=3", "spectrum", 2, 1e6, 5.0, 1.0, None, 9), ("run=1", "scan=3", "spectrum", None, 2e6, 5.0, 1.0, None, 9)]
    return spark.createDataFrame(rows, schemas.LONG)


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    """The same rows in a store written at once and in a growing one, in several files."""
    folder = tmp_path_factory.mktemp("indexed")
    long = long_table(spark).withColumn("run_id", F.when(F.col("run_id") != "", F.col("run_id")))  # folders keep no empty run
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_long(long, f"{folder}/long", index=True)
        tables.add_runs(long.where("run_id in ('run=0', 'run=3')").withColumn("rt", F.lit(-1.0)), f"{folder}/runs", index=True)
        tables.add_runs(long.where("run_id is null or run_id <> 'run=0'"), f"{folder}/runs", index=True)
        tables.add_runs(long.where("run_id = 'run=0'"), f"{folder}/runs", index=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return f"{folder}/long", f"{folder}/runs"


def shown(df):
    return sorted(map(repr, df.select(*schemas.LONG.names).collect()))


ASKED = {
    "one id": ["scan=4"],
    "ids": [f"scan={i}" for i in range(0, 40, 3)],
    "unknown": ["scan=4000"],
    "none": [],
    "pairs": [("run=2", "scan=11"), ("Z\u00e9", "scan=9"), ("run=5", "scan=8"), ("run=1", "scan=3"), ("run=3", "scan=nowhere")],
    "many pairs": [(f"run={i}", f"scan={j}") for i in range(6) for j in range(0, 40, 2)],
    "null ids": ["scan=9", None],
    "only null keys": [(None, "scan=1")],
    "null keys": [(None, "scan=1"), ("run=0", None), ("run=0", "scan=7")],
}


@pytest.mark.parametrize("asked", ASKED)
@pytest.mark.parametrize("store", [0, 1])
def test_the_same_rows_as_without_an_index(spark, stores, asked, store):
    long, index = tables.read_runs(spark, stores[store]), tables.read_index(spark, stores[store])
    want = shown(extract.fetch_by_ids(long, ASKED[asked]))
    assert shown(extract.fetch_indexed(long, index, ASKED[asked])) == want
    assert bool(want) == (asked not in ("unknown", "none", "only null keys"))


@pytest.mark.parametrize("most", [1, 3, 10_000])
def test_a_table_of_ids_and_bounds_of_any_number(spark, stores, monkeypatch, most):
    monkeypatch.setattr(extract, "MOST_PLACES", most * 4)
    monkeypatch.setattr(extract, "MOST_COVERS", most)
    long, index = tables.read_long(spark, stores[0]), tables.read_index(spark, stores[0])
    for ids in (spark.createDataFrame(ASKED["many pairs"][:11], "run_id string, id string"), spark.createDataFrame([("scan=5",)], "id string")):
        assert shown(extract.fetch_indexed(long, index, ids)) == shown(extract.fetch_by_ids(long, ids))


def rows_read(df):
    """Rows that the scan hands on: those of the row groups and pages that the bounds leave."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()


@pytest.mark.parametrize("store", [0, 1])
def test_less_is_read(spark, stores, store):
    long, index = tables.read_runs(spark, stores[store]), tables.read_index(spark, stores[store])
    pairs = [("run=2", "scan=11"), ("run=4", "scan=30")]
    assert 0 < rows_read(extract.fetch_indexed(long, index, pairs)) < long.count() / 2


def test_index_rows(spark, stores):
    for store in stores:
        index = tables.read_index(spark, store)
        assert index.schema == schemas.INDEX
        # 8 runs of 40 scans (the two without a name are one), the null id, two more places of one spectrum
        assert index.count() == 8 * 40 + 1 + 2
        assert index.where("id = 'scan=3' and run_id = 'run=1'").count() == 3


def test_no_rows(spark, tmp_path):
    nothing = long_table(spark).limit(0)
    tables.write_long(nothing, f"{tmp_path}/long", index=True)
    long, index = tables.read_long(spark, f"{tmp_path}/long"), tables.read_index(spark, f"{tmp_path}/long")
    assert index.count() == 0 and extract.fetch_indexed(long, index, ["scan=1"]).count() == 0
