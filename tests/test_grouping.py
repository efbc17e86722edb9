"""Skewed groups: one key holds a third of the rows and more, and is cut into pieces."""

import random

import pytest
from pyspark.sql import functions as F

from ionframe.operators import grouping, layout


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(3)
    keys = ["hot"] * 300 + [f"k{pick.randrange(60)}" for _ in range(500)] + [None] * 40
    places = {}
    out = []
    for k in keys:
        places[k] = places.get(k, -1) + 1
        out.append((k, places[k] * 3, pick.random()))
    pick.shuffle(out)
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, at int, v double").repartition(5)


@pytest.mark.parametrize("piece", [3, 21, 10_000])
def test_ordinal(df, piece):
    numbered = grouping.ordinal(df.repartition("k"), ["k"], ["at"], "n", F.floor(F.col("at") / F.lit(piece))).collect()
    assert len(numbered) == 840
    assert all(r.n == r["at"] // 3 for r in numbered)


def test_pack(df, rows):
    packed = grouping.pack(df.filter("k is not null"), ["k"], ["at"], ["v"]).collect()
    got = {r.k: [(i["at"], i["v"]) for i in r["items"]] for r in packed}
    assert len(got) == len(packed)
    for k, items in got.items():
        assert items == sorted((a, v) for key, a, v in rows if key == k)


def test_pack_under(spark, df, rows):
    heads = spark.createDataFrame([("hot", "H"), ("k1", "one"), ("empty", "E")], "k string, name string")
    packed = grouping.pack_under(heads, df, ["k"], ["at"], ["v"]).collect()
    got = {(r.k, r.name): [(i["at"], i["v"]) for i in r["items"]] for r in packed}
    assert len(packed) == 3 and set(got) == {("hot", "H"), ("k1", "one"), ("empty", "E")}
    for (k, _), items in got.items():
        assert items == sorted((a, v) for key, a, v in rows if key == k)


def test_layout_round_trip(spark):
    wide = spark.createDataFrame(
        [
            ("r", "a", 1, 1.5, None, [float(i) for i in range(25)], [float(i * 2) for i in range(25)]),
            ("r", "b", 2, 2.5, 0.5, [5.0, 4.0], [1.0, 2.0, 3.0]),
            ("r", "c", 1, 3.5, None, [], []),
            ("r", "d", 1, 4.5, None, None, [1.0, 2.0, 3.0]),
        ],
        "run_id string, id string, ms_level byte, rt float, ion_mobility float, mz_array array<double>, intensity_array array<float>",
    )
    long = layout.spectra_to_long(wide)
    assert long.count() == 27
    assert {r.id: r.n_peaks for r in layout.with_mz_range(wide).collect()} == {"a": 25, "b": 2, "c": 0, "d": 0}
    back = layout.pack_spectra(long)
    assert sorted(r.id for r in back.collect()) == ["a", "b"]
    order = lambda d: [(r.id, r.mz, r.intensity) for r in d.orderBy("id", "peak_index").collect()]
    assert order(layout.spectra_to_long(back)) == order(long)
