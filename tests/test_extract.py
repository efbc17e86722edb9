import random

import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from ionframe.functions import codec, vocab
from ionframe.functions import columns as C
from ionframe.operators import extract, layout, precursor
from ionframe.sources import tables


@pytest.fixture(scope="module")
def wide(spark):
    pick = random.Random(1)
    rows = []
    for i in range(120):
        # A third of all peaks sit at one m/z.
        mz = sorted(500.25 if pick.random() < 0.33 else round(pick.uniform(200, 900), 3) for _ in range(pick.randrange(12)))
        rows.append(("r", f"s{i}", "spectrum", i % 3 + 1, float(i), None, mz, [float(x) for x in range(len(mz))]))
    df = spark.createDataFrame(
        rows,
        "run_id string, id string, data_type string, ms_level byte, rt float, ion_mobility float,"
        "mz_array array<float>, intensity_array array<float>",
    )
    return layout.with_mz_range(df).cache()


@pytest.fixture(scope="module")
def long(wide):
    return layout.spectra_to_long(wide).cache()


def key(df):
    return sorted((r.id, r.mz, r.intensity) for r in df.collect())


def test_wide_and_long_give_the_same_peaks(wide, long):
    box = (500.0, 60.0, 50.0, 30.0, 2)
    assert key(extract.extract_box(long, *box)) == key(extract.extract_box_wide(wide, *box)) != []
    ids = {r.id for r in extract.extract_box(long, *box).collect()}
    assert {r.id for r in extract.spectra_with_mz(wide, *box).collect()} == ids


def test_bounds_are_closed_and_float(spark):
    df = spark.createDataFrame([("spectrum", 1, 10.0, 10.1)], "data_type string, ms_level byte, rt float, mz float")
    assert extract.extract_box(df, 10.0, 0.1, 9.0, 1.0, 1).count() == 1
    assert extract.extract_box(df, 10.2, 0.1, 11.0, 1.0, 1).count() == 1
    assert extract.extract_box(df, 10.3, 0.1, 11.0, 1.0, 1).count() == 0


def scan_of(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    plan = capsys.readouterr().out
    return next(line for line in plan.splitlines() if "PushedFilters" in line)


def test_box_reaches_the_scan(spark, long, tmp_path, capsys):
    tables.write_long(long, str(tmp_path / "long"), distinct_ids=200)
    stored = tables.read_long(spark, str(tmp_path / "long"))
    assert key(stored) == key(long)
    box = extract.extract_box(stored, 500.0, 60.0, 50.0, 30.0, 2)
    assert key(box) == key(extract.extract_box(long, 500.0, 60.0, 50.0, 30.0, 2))
    pushed = scan_of(box, capsys)
    for c in ("EqualTo(data_type", "EqualTo(ms_level", "LessThanOrEqual(rt", "GreaterThanOrEqual(mz"):
        assert c in pushed
    fetched = extract.fetch_by_ids(stored, ["s1", "s4"])
    assert {r.id for r in fetched.collect()} == {"s1", "s4"}
    assert "In(id" in scan_of(fetched, capsys)


@pytest.mark.parametrize("as_frame", [False, True])
@pytest.mark.parametrize("cells", [(), (7.0, 3.0), (200.0, 500.0)])
def test_many_boxes_against_brute_force(spark, long, as_frame, cells):
    pick = random.Random(2)
    boxes = [
        (i, pick.choice([1, 2, 3]), pick.uniform(200, 900), pick.uniform(0, 80), pick.uniform(0, 120), pick.uniform(0, 40))
        for i in range(40)
    ]
    boxes += [(100 + i, 1, 500.25, 0.0, 60.0, 60.0) for i in range(20)]  # copies of one box, on the crowded m/z
    table = spark.createDataFrame([(*b, None) for b in boxes], extract.BOXES) if as_frame else extract.box_table(spark, boxes)
    hits = extract.extract_boxes(long, table, *cells)
    got = sorted((r.box_id, r.id, r.mz, r.intensity) for r in hits.collect())
    import numpy as np

    f = np.float32
    want = sorted(
        (b, r.id, r.mz, r.intensity)
        for r in long.collect()
        for b, level, mz, mt, rt, tt in boxes
        if r.ms_level == level and f(mz - mt) <= f(r.mz) <= f(mz + mt) and f(rt - tt) <= f(r.rt) <= f(rt + tt)
    )
    assert got == want and want
    counts = {r.box_id: r.n_hits for r in extract.hits_per_box(hits, table).collect()}
    assert len(counts) == 60 and sum(counts.values()) == len(want) and 0 in counts.values()


def test_random_boxes(spark, long):
    drawn = extract.random_boxes(spark, 50, 2)
    rows = drawn.collect()
    assert rows == extract.random_boxes(spark, 50, 2).collect() != extract.random_boxes(spark, 50, 2, seed=7).collect()
    assert drawn.schema.names == extract.BOXES.names and len({r.mz for r in rows}) == 50
    assert all(200 <= r.mz <= 2000 and 100 <= r.rt <= 1100 and (r.mz_tol, r.rt_tol) == (0.1, 60.0) for r in rows)
    wide_boxes = extract.random_boxes(spark, 20, 1, mz=(200, 900), rt=(0, 120), mz_tol=90.0)
    per_box = extract.hits_per_box(extract.extract_boxes(long, wide_boxes), wide_boxes)
    assert {r.box_id: r.n_hits for r in per_box.collect()} == {
        b.box_id: extract.extract_box(long, b.mz, b.mz_tol, b.rt, b.rt_tol, 1).count() for b in wide_boxes.collect()
    }


def test_labels_belong_to_their_vocabulary():
    for terms, labels in (
        (vocab.POLARITY_TERMS, vocab.POLARITY), (vocab.INLET_TERMS, vocab.INLET_TYPE),
        (vocab.IONIZATION_TERMS, vocab.IONIZATION_METHOD), (vocab.ANALYZER_TERMS, vocab.ANALYZER_TYPE),
        (vocab.RESOLUTION_METHOD_TERMS, vocab.RESOLUTION_METHOD), (vocab.RESOLUTION_TYPE_TERMS, vocab.RESOLUTION_TYPE),
        (vocab.SCAN_DIRECTION_TERMS, vocab.SCAN_DIRECTION), (vocab.SCAN_LAW_TERMS, vocab.SCAN_LAW),
        (vocab.REFLECTRON_TERMS, vocab.REFLECTRON_STATE), (vocab.CHECKSUM_TERMS, vocab.CHECKSUM_TYPE),
    ):
        assert set(terms.values()) <= set(labels)


def test_fetch(spark, long):
    many = [f"s{i}" for i in range(0, 3000, 2)]
    assert key(extract.fetch_by_ids(long, many)) == key(long.filter("cast(substr(id, 2) as int) % 2 = 0"))
    ids = layout.distinct_ids(long)
    sample = [r.id for r in extract.sample_ids(ids, 10).collect()]
    assert len(set(sample)) == 10 and sorted(sample) == sorted(r.id for r in extract.sample_ids(ids, 10).collect())
    assert {r.id for r in extract.fetch_sampled(long, ids, 10).collect()} == set(sample)


def test_ids_start_anew_in_each_run(spark, long):
    two = long.unionByName(long.withColumn("run_id", F.lit("q")))
    ids = layout.distinct_ids(two)
    assert ids.count() == 2 * layout.distinct_ids(long).count()
    both = extract.fetch_by_ids(two, ["s1"])
    own = extract.fetch_by_ids(two, [("q", "s1")])
    assert both.count() == 2 * own.count() > 0 and {r.run_id for r in own.collect()} == {"q"}
    assert key(extract.fetch_by_ids(two, ids.filter("run_id = 'q' and id = 's1'"))) == key(own)
    sample = extract.sample_ids(ids, 5)
    assert extract.fetch_sampled(two, ids, 5).select("run_id", "id").distinct().count() == sample.count() == 5


def test_a_box_for_one_run(spark, long):
    two = long.unionByName(long.withColumn("run_id", F.lit("q")))
    boxes = extract.box_table(spark, [(1, 1, 500.25, 0.1, 50.0, 60.0), (2, 1, 500.25, 0.1, 50.0, 60.0, "q"), (3, 2, 550.0, 400.0, 60.0, 70.0)])
    hits = {r.box_id: r.n for r in extract.extract_boxes(two, boxes).groupBy("box_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert hits[1] == 2 * hits[2] == extract.extract_box(two, 500.25, 0.1, 50.0, 60.0, 1).count()
    assert hits[3] == extract.extract_box(two, 550.0, 400.0, 60.0, 70.0, 2).count()


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_precursors_against_brute_force(spark, block):
    pick = random.Random(5)
    rows = [("big" if i < 150 else f"r{i % 4}", i * 2, f"s{i}", pick.choice([1, 1, 2, 3, 4]), float(i)) for i in range(300)]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "run_id string, scan_index long, id string, ms_level byte, rt float")
    found = {r.id: (r.precursor_index, r.precursor_id, r.precursor_rt) for r in precursor.precursor_asof(df, block).collect()}
    assert len(found) == 300
    for run, index, name, level, _ in rows:
        before = [x for x in rows if x[0] == run and x[1] < index and x[3] == level - 1]
        last = max(before, key=lambda x: x[1], default=None)
        assert found[name] == ((last[1], last[2], last[4]) if last else (None, None, None))


def test_columns(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0, 3.0], [9.0, 8.0], 0.0, "{u}a", " \t\u2003x y\n", 300)], "a array<double>, b array<double>, z double, t string, s string, big int"
    )
    row = df.select(
        C.zip_shortest(F.col("a"), F.col("b"), "x", "y").alias("zip"),
        C.null_if_zero(F.col("z")).alias("z"),
        C.clean_tag(F.col("t")).alias("t"),
        C.strip(F.col("s")).alias("s"),
        C.label(F.col("t"), {"q": "Q"}).alias("label"),
        C.label(F.col("t"), {"q": "Q"}, "UNKNOWN_CHECKSUM").alias("sum"),
        C.merge_maps(F.create_map(F.lit("k"), F.lit("old")), F.create_map(F.lit("k"), F.lit("new"), F.lit("n"), F.lit("1"))).alias("m"),
    ).first()
    assert [(p.x, p.y) for p in row.zip] == [(1.0, 9.0), (2.0, 8.0)]
    assert (row.z, row.t, row.s, row.label, row["sum"]) == (None, "a", "x y", "UNKNOWN", "UNKNOWN_CHECKSUM")
    assert row.m == {"k": "old", "n": "1"}
    assert layout.narrow(df, {"big": "byte"}, strict=False).first().big is None
    with pytest.raises(ArithmeticException):
        layout.narrow(df, {"big": "byte"}).collect()


@pytest.mark.parametrize("bits", [32, 64])
@pytest.mark.parametrize("zipped", [True, False])
def test_codec(spark, bits, zipped):
    df = spark.createDataFrame([([1.5, -2.25, 1e10],), ([],), (None,)], "v array<double>")
    text = codec.encode_array(F.col("v"), F.lit(bits), F.lit(zipped))
    back = df.withColumn("t", text).select("v", codec.decode_array(F.col("t"), F.lit(bits), F.lit(zipped)).alias("d"))
    assert all(r.v == r.d for r in back.collect())


def test_boxes_of_any_width(spark, long):
    inf = float("inf")
    boxes = [
        (0, 1, 500.0, 1e9, 100.0, 1e9), (1, 2, 500.0, inf, 100.0, inf), (2, 1, 300.0, 0.0, 60.0, 0.0), (3, 2, 800.0, 333.0, 50.0, 7.5),
        (4, 1, -5.0, 600.0, -3.0, 90.0), (5, 1, 700.0, -1.0, 10.0, 5.0), (6, 3, 512.0, 1.0, 64.0, 64.0), (7, 1, 511.5, 256.25, 120.0, 119.0),
    ]
    table = extract.box_table(spark, boxes)
    cells = {r.box_id: r["count"] for r in extract.box_cells(table, 0.01, 0.5).groupBy("box_id").count().collect()}
    assert set(cells) == {0, 1, 2, 3, 4, 6, 7} and max(cells.values()) <= 4
    for widths in ((0.01, 0.5), (1.0, 120.0)):
        found = extract.extract_boxes(long, table, *widths)
        got = {r.box_id: r.n_hits for r in extract.hits_per_box(found, table).collect()}
        assert got == {b[0]: extract.extract_box(long, *b[2:], b[1]).count() for b in boxes}
    assert extract.extract_boxes(long, table.limit(0)).count() == 0
