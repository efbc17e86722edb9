"""Files read in byte ranges against Spark's XML source: borders in tags, comments, CDATA, instructions and base64."""

import io

import mzml_files as M
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ionframe.sources import mzml, ranges


def whole(data: bytes, tag: str = "s") -> list[bytes]:
    return list(ranges.elements(ranges.Bytes(io.BytesIO(data), 0), 0, len(data), 0, tag))


def in_ranges(data: bytes, size: int, tag: str = "s") -> list[bytes]:
    state, out = 0, []
    for start in range(0, len(data), size):
        end, before = min(start + size, len(data)), max(start - 3, 0)
        out += ranges.elements(ranges.Bytes(io.BytesIO(data), before), start, end, state, tag)
        state = ranges.end_state(ranges.Bytes(io.BytesIO(data), before), start, end, state)
    return out


PIECES = [b"<s a='>'>x</s>", b'<s b=">/>"/>', b"<s/>", b"<s\n>-- ]] ></s >", b"<!-- <s> -- > </s> -->", b"<![CDATA[<s>]]]]>", b"<?p <s> ?>", b"<sList>",
          b"</sList>", b"text -->", b"]]>", b"<s><!-- </s> --><![CDATA[</s>]]><?x </s>?><st>y</st></s>", b"<st>", b"\xc3\xa9", b"<!---->", b"<s>" + b"QUJD" * 9 + b"</s>"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=8), st.integers(1, 40), st.integers(1, 64))
def test_any_cut_gives_the_same_elements(pieces, size, block):
    data, known = b"<a>" + b"".join(pieces) + b"</a>", (ranges.BLOCK, ranges.TOKEN)
    want = whole(data)
    try:
        ranges.BLOCK, ranges.TOKEN = block, 16
        assert in_ranges(data, size) == want
    finally:
        ranges.BLOCK, ranges.TOKEN = known


def test_what_an_element_is():
    assert whole(b"<a><!-- <s> --><s>1</s><sx>2</sx><s><t>3</t></s><![CDATA[<s/>]]><s/></a>") == [b"<s>1</s>", b"<s><t>3</t></s>", b"<s/>"]
    assert whole(b"<a><s>1</s><s>2") == [b"<s>1</s>", b"<s>2"]
    assert whole(b"") == whole(b"<!-- <s/>") == []


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    folder = tmp_path_factory.mktemp("range runs")
    spectra = [M.spectrum(k, [100.0 + k, 200.5], [1.0, k], extra="<!-- <spectrum id='no'> -->" if k % 3 else "") for k in range(12)]
    spectra.insert(5, "<!--" + M.spectrum(99, [1.0], [1.0]) + "-->")
    files = [M.write(folder, "a.mzML", M.run(spectra, [M.chromatogram(k, [0.5, 1.0], [7.0, 8.0]) for k in range(3)]))]
    files.append(M.write(folder, "b.mzML", M.run((), [M.chromatogram(0, [3.0], [1.0], 808.5, 689.25)])))
    return [*files, M.write(folder, "empty.mzML", "")]


@pytest.mark.parametrize("size", [401, 1 << 20])
def test_spectra_and_chromatograms_as_the_xml_source_gives_them(spark, paths, size):
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(mzml.read_spectra(spark, paths, range_bytes=size)) == rows(mzml.read_spectra(spark, paths))
    assert rows(mzml.read_chromatogram_meta(spark, paths, range_bytes=size)) == rows(mzml.read_chromatogram_meta(spark, paths))


def test_one_file_is_read_by_many_tasks(spark, paths):
    texts = ranges.read_element_texts(spark, paths[:1], "spectrum", 700)
    used = texts.selectExpr("spark_partition_id() as p").distinct().count()
    assert texts.count() == 12 and used > 5 and "é" not in texts.first().xml


def test_a_cut_file_ends_in_quarantine(spark, paths, tmp_path):
    data = open(paths[0], "rb").read()
    path = M.write(tmp_path, "cut.mzML", data[: data.index(b'id="scan=4"') + 200].decode("iso-8859-1"))
    elements = mzml.read_elements(spark, path, "spectrum", mzml.SPECTRUM_XML, range_bytes=500)
    assert [r.error for r in mzml.quarantine(elements).collect()] == ["not well-formed"] and mzml.spectra_of(elements).count() == 3
