"""Rebuilt documents and JSON objects as files."""

import json
import xml.etree.ElementTree as ET
from pathlib import Path

import pytest
import test_tree

from ionframe.operators import tree


@pytest.fixture
def many_files(spark):
    """Tasks as small as they come, so that documents fall apart into several files."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def flat_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, path string, value string")


def large(doc, n):
    rows = [(doc, "run:@z", "last"), (doc, "run:@a", 'q"<>&\n'), (doc, "run:#text", "mixed > text")]
    for i in range(n):
        rows += [(doc, f"run:peak[{i}]:@mz", str(i)), (doc, f"run:peak[{i}]:@id", f"p{i}"), (doc, f"run:peak[{i}]:#text", f"<é> & {i}\n x")]
        rows += [(doc, f"run:scan[{2 * i}]:sub[0]:#text", str(i)), (doc, f"run:scan[{2 * i}]:@n", str(i))]
    return rows


ODD = [
    ("a b/c=d%", "r:x[0]:@k", "1"), ("a b/c=d%", "r:x[0]:@k", "2"), ("a b/c=d%", "r:x[0]:#text", "s"), ("a b/c=d%", "r:x[0]:#text", "t"),
    ("007", "r:@only", ""), ("7", "r:#text", "text"), ("two roots", "r:@a", "1"), ("two roots", "s:@a", "1"),
    ("indexed root", "r[0]:@a", "1"), ("blank", "r:x[1]:#text", ""), ("bad key", "r:x:@a", "1"),
]


def documents(folder):
    """What lies in the files, by plain reading."""
    found = {}
    for file in sorted(Path(folder).glob("doc_id=*/part-*")):
        found[file.parent.name] = found.get(file.parent.name, b"") + file.read_bytes()
    return found


@pytest.mark.parametrize("namespace", [None, "urn:x"])
def test_files_are_the_rebuilt_documents(spark, tmp_path, many_files, namespace):
    flat = flat_frame(spark, large("large", 200) + ODD + test_tree.KEYS)
    tree.write_document_files(flat, f"{tmp_path}/out", namespace)
    want = {r.doc_id: tree.XML_DECLARATION + r.xml for r in tree.rebuild(flat, namespace).collect()}
    got = {r.doc_id: r.xml for r in tree.read_document_files(spark, f"{tmp_path}/out").collect()}
    assert {k: v.replace("<!---->", "") for k, v in got.items()} == want and len(want) > 4
    assert sorted(k for k, v in got.items() if "<!---->" in v) == ["large", "mixed"]
    plain = documents(f"{tmp_path}/out")
    assert sorted(v.decode() for v in plain.values()) == sorted(got.values())
    assert len(list(Path(f"{tmp_path}/out/doc_id=large").glob("part-*"))) > 2
    for text in plain.values():
        assert ET.fromstring(text).tag in ({"run", "r"} if namespace is None else {"{urn:x}run", "{urn:x}r"})


def test_round_trip_through_files(spark, tmp_path, many_files):
    rows = large("one", 60) + large("two", 3)
    tree.write_document_files(flat_frame(spark, rows), f"{tmp_path}/out")
    back = tree.flatten(tree.nodes(tree.read_document_files(spark, f"{tmp_path}/out")))
    # An XML attribute reads a line end as it was written escaped; a text keeps its own.
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_json_files(spark, tmp_path, many_files):
    rows = [("d", f"k{i:03}", f'v"é{i}') for i in range(300)] + [("e", "x", "1"), ("e", "x", "2"), ("e", "", "empty key"), ("f", "n", None)]
    tree.write_flat_json_files(flat_frame(spark, rows), f"{tmp_path}/out")
    plain = {k: v.decode() for k, v in documents(f"{tmp_path}/out").items()}
    assert {k: json.loads(v) for k, v in plain.items()} == {
        "doc_id=d": {p: v for d, p, v in rows if d == "d"}, "doc_id=e": {"": "empty key", "x": "2"}, "doc_id=f": {"n": None},
    }
    assert all(v.isascii() and list(json.loads(v)) == sorted(json.loads(v)) for v in plain.values())
    assert len(list(Path(f"{tmp_path}/out/doc_id=d").glob("part-*"))) > 2
    back = tree.from_json_objects(tree.read_document_files(spark, f"{tmp_path}/out", "json"))
    assert sorted(map(repr, back.collect())) == sorted(f"Row(doc_id={d!r}, path={p!r}, value={v!r})" for d, p, v in rows if v != "1" or d != "e")


def test_ids_that_name_no_folder_and_no_rows(spark, tmp_path):
    tree.write_document_files(flat_frame(spark, [(None, "r:@a", "1"), ("", "r:@a", "1"), ("x", "r:@a", "1")]), f"{tmp_path}/some")
    assert [r.doc_id for r in tree.read_document_files(spark, f"{tmp_path}/some").collect()] == ["x"]
    for write, name in ((tree.write_document_files, "xml"), (tree.write_flat_json_files, "json")):
        write(flat_frame(spark, []), f"{tmp_path}/{name}")
        assert tree.read_document_files(spark, f"{tmp_path}/{name}", name).count() == 0


def test_keys_are_parsed_once(spark, monkeypatch):
    """Parsing is the costly part of writing documents: it must not be repeated in filters or further plans."""
    plans = []

    def staged(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df.checkpoint()

    monkeypatch.setattr(tree, "staged", staged)
    lines = tree.document_lines(flat_frame(spark, large("d", 5)))
    plans.append(lines._jdf.queryExecution().optimizedPlan().toString())
    assert sum(p.count("regexp_extract") for p in plans) == 1
