"""Files compressed in blocks: read from any block on, in ranges, and as Spark writes them."""

import io
import os
import re
from pathlib import Path

import mzml_files as M
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ionframe.operators import grouping
from ionframe.plans import bridge
from ionframe.sources import blocks, mzml, ranges
from test_ranges import PIECES, whole

SMALL = "/root/testdata/sf0.001"


def blocked(parts: list[list[bytes]]) -> bytes:
    """A file of blocks, each given as the contents of its chunks."""
    number = lambda n: n.to_bytes(4, "big")
    chunk = lambda data: (lambda c: number(len(c)) + c)(pa.compress(data, "snappy", asbytes=True))
    return b"".join(number(sum(map(len, p))) + b"".join(map(chunk, p)) for p in parts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=1, max_size=300), max_size=3), max_size=6), st.integers(0, 900), st.integers(1, 300))
def test_content_from_any_place(parts, place, size):
    content, file = b"".join(b for p in parts for b in p), io.BytesIO(blocked(parts))
    found = list(blocks.places(file))
    assert found[-1] == (len(content), len(file.getvalue())) and len(found) == len(parts) + 1
    base, at = [f for f in found if f[0] <= place][-1]
    opened = blocks.Blocks(file, at, base)
    for _ in range(2):  # it may go back
        opened.seek(place)
        assert opened.read(size) + opened.read(size) == content[place : place + 2 * size]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=8), st.lists(st.integers(1, 30), min_size=60, max_size=60), st.integers(1, 60))
def test_ranges_of_blocks_give_the_same_elements(pieces, sizes, range_bytes):
    data = b"<a>" + b"".join(pieces) + b"</a>"
    parts, at = [], 0
    for size in sizes + [len(data)]:
        if data[at : at + size]:
            parts.append([data[at : at + size]])
        at += size
    packed = blocked(parts)
    state, out, end = 0, [], 0
    for r in ranges.block_ranges(io.BytesIO(packed), range_bytes):
        opened = lambda: blocks.Blocks(io.BytesIO(packed), r["at"], r["base"])
        out += ranges.elements(ranges.Bytes(opened(), ranges._before(r["start"])), r["start"], r["end"], state, "s")
        to = ranges.end_states(opened(), r["start"], r["end"])
        assert to == [ranges.end_state(ranges.Bytes(io.BytesIO(data), ranges._before(r["start"])), r["start"], r["end"], s) for s in range(4)]
        assert r["start"] == end
        state, end = to[state], r["end"]
    assert end == len(data) and out == whole(data)


def test_files_that_spark_writes_are_read_in_ranges(spark, tmp_path):
    text = M.run([M.spectrum(k, [100.0 + k] * 3000, [1.0] * 3000) for k in range(40)] + ["<!--" + "x" * 700_000 + "-->"])
    content = text.replace("é", "e")
    plain = M.write(tmp_path, "a.mzML", content)
    lines = spark.createDataFrame([(content,)], "value string")
    lines.write.option("compression", "snappy").text(f"{tmp_path}/snappy")
    written = f"{tmp_path}/snappy/*.snappy"
    rows = lambda df: sorted(map(repr, df.drop("run_id").collect()))
    assert ranges.file_ranges(spark, written, 100_000).count() > 1
    headers = [mzml.read_headers(spark, p) for p in (plain, written)]
    assert rows(headers[0]) == rows(headers[1]) and headers[0].count() == 1
    want, got = (mzml.read_spectra(spark, p, range_bytes=100_000) for p in (plain, written))
    assert rows(want) == rows(got) and want.count() == 40


def test_many_ranges_share_tasks(spark, tmp_path, monkeypatch):
    path = M.write(tmp_path, "a.mzML", M.run([M.spectrum(k, [100.0], [1.0]) for k in range(60)]))
    monkeypatch.setattr(ranges, "FEW_TASKS", 3)
    texts = ranges.read_element_texts(spark, path, "spectrum", 700)
    assert ranges.file_ranges(spark, path, 700).count() > 9 and texts.rdd.getNumPartitions() == 3 and texts.count() == 60


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("all_keys", ["false", "true"])
def test_run_files_take_little_room(spark, tmp_path, all_keys):
    """Compressed, they take a fifth at most, and each is one file that holds its whole run."""
    def size(folder):
        return sum(f.stat().st_size for f in Path(folder).rglob("*.txt*"))

    spark.conf.set("spark.sql.requireAllClusterKeysForDistribution", all_keys)
    try:
        bridge.write_run_files(spark, SMALL, f"{tmp_path}/plain")
        bridge.write_run_files(spark, SMALL, f"{tmp_path}/small", compression="snappy")
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForDistribution")
    assert size(f"{tmp_path}/small") < size(f"{tmp_path}/plain") / 5
    assert len(list(Path(f"{tmp_path}/small").rglob("*.snappy"))) == bridge.RUN_FILES
    for file in Path(f"{tmp_path}/plain").rglob("*.txt"):
        text = file.read_text()
        ids = [int(i) for i in re.findall(r'<spectrum index="(\d+)"', text)]
        assert text.startswith("<?xml") and text.endswith("</mzML>\n") and ids == sorted(ids) and ids


def test_groups_come_together_by_some_keys(spark):
    heads = spark.range(40).selectExpr("id", "id % 3 as file")
    packed = grouping.pack_under(heads, heads.selectExpr("id", "file", "id as v"), ("file", "id"), ("v",), ("v",), tasks=5, by=("file",))
    tasks = packed.selectExpr("file", "spark_partition_id() as p").distinct().count()
    assert tasks == 3 and packed.rdd.getNumPartitions() == 5 and packed.count() == 40
