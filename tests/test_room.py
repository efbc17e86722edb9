"""What is kept between stages, and the files of documents, take little room."""

from pathlib import Path

from test_document_files import flat_frame, large

from ionframe import session
from ionframe.operators import tree


def test_kept_rows_are_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_path", lambda spark, name: f"{tmp_path}/kept")
    before = set(Path(session.checkpoint_folder(spark).removeprefix("file:")).rglob("part-*"))
    rows = spark.range(20_000).selectExpr("id", "concat('run:order[', id, ']:line[', id % 7, ']:@part') AS path", "CAST(NULL AS string) AS value")
    kept = session.staged(rows)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, rows.collect())) and kept.dtypes == rows.dtypes
    new = set(Path(session.checkpoint_folder(spark).removeprefix("file:")).rglob("part-*")) - before
    assert sum(f.stat().st_size for f in [*new, *Path(tmp_path).rglob("*.parquet")]) < 20_000 * 30


def test_compressed_document_files(spark, tmp_path):
    flat = flat_frame(spark, large("one", 300) + large("two", 3))
    tree.write_document_files(flat, f"{tmp_path}/plain")
    tree.write_document_files(flat, f"{tmp_path}/small", compression="snappy")
    rows = lambda path: sorted(map(tuple, tree.read_document_files(spark, path).collect()))
    size = lambda path: sum(f.stat().st_size for f in Path(path).rglob("part-*"))
    assert rows(f"{tmp_path}/plain") == rows(f"{tmp_path}/small") and size(f"{tmp_path}/small") < size(f"{tmp_path}/plain") / 2
