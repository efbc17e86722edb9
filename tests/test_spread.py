"""The XML text of the tables is made by as many tasks as their rows make work for."""

import os

import pytest

from ionframe.plans import bridge

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_text_is_spread_by_rows(spark, monkeypatch):
    monkeypatch.setattr(bridge, "SPECTRA_PER_TASK", 100)
    monkeypatch.setattr(bridge, "HEADERS_PER_TASK", 10)
    spectra, runs = (bridge.table(spark, SMALL, name).count() for name in ("orders", "customer"))
    for arrays in (True, False):
        assert bridge.spectrum_xml(spark, SMALL, arrays).rdd.getNumPartitions() == -(-spectra // 100)
    assert bridge.header_xml(spark, SMALL).rdd.getNumPartitions() == -(-runs // 10)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_run_files_follow_the_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(bridge, "SPECTRA_PER_FILE", 100)
    bridge.write_run_files(spark, SMALL, str(tmp_path / "runs"))
    spectra = bridge.table(spark, SMALL, "orders").count()
    assert len(list((tmp_path / "runs").rglob("*.txt"))) == -(-spectra // 100)
