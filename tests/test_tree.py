import json
from xml.etree import ElementTree as ET

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ionframe.operators import tree
from ionframe.sources import xmltext


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, xml string")


def pairs(flat):
    return sorted((r.doc_id, r.path, r.value) for r in flat.collect())


def flat_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, path string, value string")


def test_flatten(spark):
    flat = tree.flatten(tree.nodes(docs(
        spark,
        '<?xml version="1.0"?><r xmlns="u" xmlns:x="v" b="2" x:a="1"> \n <c> t\u00e9 </c><d/><c k="&lt;&quot;"> \t</c></r>',
    )))
    assert pairs(flat) == [
        ("d0", "r:@a", "1"), ("d0", "r:@b", "2"), ("d0", "r:c[0]:#text", "t\u00e9"), ("d0", "r:c[1]:@k", '<"'),
    ]


def test_nodes(spark):
    rows = {r.node_id: r for r in tree.nodes(docs(spark, "<r><a/><b><a>x</a></b><a/></r>")).collect()}
    assert [(rows[i].tag, rows[i].parent_id, rows[i].depth, rows[i].pos, rows[i].path) for i in range(5)] == [
        ("r", None, 0, 0, "r"), ("a", 0, 1, 0, "r:a[0]"), ("b", 0, 1, 1, "r:b[0]"),
        ("a", 2, 2, 0, "r:b[0]:a[0]"), ("a", 0, 1, 2, "r:a[1]"),
    ]


def test_sibling_index_agrees_with_paths(spark):
    text = "<r>" + "".join(f"<{'ab'[i % 2]}><c/></{'ab'[i % 2]}>" for i in range(31)) + "</r>"
    numbered = tree.sibling_index(tree.nodes(docs(spark, text)))
    for r in numbered.collect():
        assert r.path == "r" or r.path.endswith(f"[{r.sibling_index}]")


def test_equal_paths_from_two_namespaces(spark):
    text = (
        '<r xmlns:p="u" xmlns:q="v"><a k="1" m="0">t</a><p:a k="2" z="3"><b k="5"/></p:a><a/>'
        '<q:a k="9">w<c/>tail</q:a></r>'
    )
    assert pairs(tree.flatten(tree.nodes(docs(spark, text)))) == [
        ("d0", "r:a[0]:#text", "w"), ("d0", "r:a[0]:@k", "9"), ("d0", "r:a[0]:@m", "0"), ("d0", "r:a[0]:@z", "3"),
        ("d0", "r:a[0]:b[0]:@k", "5"),
    ]


def test_quarantine(spark):
    bad = tree.nodes(docs(spark, "<a><b></a>", "<a/>", "<!DOCTYPE html><a>&nbsp;</a>", "", None, "<a>"))
    assert sorted(r.doc_id for r in tree.quarantine(bad).collect()) == ["d0", "d2", "d3", "d4", "d5"]
    assert bad.filter("doc_id = 'd0'").count() == 1


@pytest.mark.parametrize("broken", [False, True])
def test_documents_longer_than_a_piece(spark, monkeypatch, broken):
    monkeypatch.setattr(xmltext, "PIECE", 50)
    monkeypatch.setattr(xmltext, "BATCH_ROWS", 7)
    text = "<r>" + "".join(f'<a i="{i}">x{i}</a>' for i in range(100)) + ("</q>" if broken else "</r>")
    got = pairs(tree.flatten(tree.nodes(docs(spark, text))))
    assert len(got) == (0 if broken else 200)
    if not broken:
        assert ("d0", "r:a[57]:#text", "x57") in got


def test_declared_encoding(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes('<?xml version="1.0" encoding="ISO-8859-1"?><r a="\xe9"/>'.encode("iso-8859-1"))
    assert [r.value for r in tree.flatten(tree.nodes(tree.read_documents(spark, str(tmp_path)))).collect()] == ["\xe9"]


KEYS = [
    ("gap", "r:a[0]:@x", "1"), ("gap", "r:a[2]:@x", '<2&"\n'), ("gap", "r:a[10]:#text", "a<b>&\"c"),
    ("gap", "r:b:@x", "9"), ("two", "r:@x", "1"), ("two", "s:@x", "1"), ("idx", "r[0]:@x", "1"),
    ("idx2", "r[0]:@x", "1"), ("idx2", "s:@x", "1"), ("none", "@x", "1"), ("bare", "r", "1"),
    ("deep", "r:c[0]:d[0]:e:@x", "1"), ("deep", "@zz", "1"), ("deep", "r:@at", "7"), ("deep", "r:@b[0]:c[0]:@x", "7"),
    ("deep", "r:#text[0]:@q", "1"), ("empty", ":@x", "1"), ("both", ":@x", "1"),
    ("both", "r:@y", "1"), ("mixed", "r:a[1]:z[0]:@k", "v"), ("mixed", "r:a[1]:#text", "t"),
    ("mixed", "r:a[1]:@b", "2"), ("mixed", "r:a[1]:@a", "1"), ("mixed", "r:B[0]", ""), ("mixed", "r:a[007]:#text", ""),
]
REBUILT = {
    "gap": '<r><a x="1" /><a /><a x="&lt;2&amp;&quot;&#10;" />' + "<a />" * 7 + '<a>a&lt;b&gt;&amp;"c</a></r>',
    "bare": "<r />",
    "deep": '<r at="7"><c><d /></c></r>',
    "mixed": '<r><B /><a /><a a="1" b="2">t<z k="v" /></a>' + "<a />" * 6 + "</r>",
}


def test_keys(spark):
    flat = flat_frame(spark, KEYS)
    assert {(r.doc_id, r.path) for r in tree.malformed_keys(flat).collect()} == {
        ("gap", "r:b:@x"), ("idx", "r[0]:@x"), ("idx2", "r[0]:@x"), ("none", "@x"), ("deep", "r:c[0]:d[0]:e:@x"),
        ("deep", "@zz"), ("deep", "r:@b[0]:c[0]:@x"), ("deep", "r:#text[0]:@q"), ("empty", ":@x"), ("both", ":@x"),
    }
    status = {r.doc_id: (r.root, r.status) for r in tree.root_check(flat).collect()}
    assert status == {
        "gap": ("r", "ok"), "bare": ("r", "ok"), "deep": ("r", "ok"), "mixed": ("r", "ok"),
        "two": (None, "multiple_roots"), "idx2": (None, "multiple_roots"), "idx": ("r[0]", "bad_root"),
        "both": (None, "multiple_roots"),
        "none": (None, "no_root"), "empty": ("", "bad_root"),
    }


def test_rebuild(spark):
    built = tree.rebuild(flat_frame(spark, KEYS), None).collect()
    assert {r.doc_id: r.xml for r in built} == REBUILT and len(built) == len(REBUILT)


def test_a_large_document_is_one_row(spark):
    flat = flat_frame(spark, [("big", f"r:a[{i}]:b[0]:@x", str(i)) for i in range(3000)] + [("small", "r:@x", "1")])
    built = {r.doc_id: r.xml for r in tree.rebuild(flat, None).collect()}
    assert built["big"] == "<r>" + "".join(f'<a><b x="{i}" /></a>' for i in range(3000)) + "</r>" and len(built) == 2


def test_repeated_keys_keep_one_value(spark):
    flat = flat_frame(spark, [("d", "r:@x", "1"), ("d", "r:@x", "2"), ("d", "r:#text", "b"), ("d", "r:#text", "a")])
    assert tree.rebuild(flat, None).first().xml == '<r x="2">b</r>'
    assert json.loads(tree.to_json_objects(flat).first().json) == {"r:#text": "b", "r:@x": "2"}


def test_long_indexes_are_placed(spark):
    keyed = tree.parse_keys(flat_frame(spark, [("d", f"r:a[{i}]:@x", "v") for i in (1234567890, 999999999, 7, "0007")]))
    assert keyed.filter("malformed").count() == 0
    named = tree.elements(keyed).filter("tag = 'a'").orderBy("key").collect()
    assert [r.idx for r in named] == [7, 999999999, 1234567890]


def test_many_siblings_keep_numeric_order(spark):
    flat = flat_frame(spark, [("d", f"r:a[{i}]:@i", str(i)) for i in range(120)])
    xml = tree.rebuild(flat, "urn:x").first().xml
    root = ET.fromstring(xml)
    assert root.tag == "{urn:x}r" and [e.get("i") for e in root] == [str(i) for i in range(120)]


def test_gap_over_several_steps(spark, monkeypatch):
    monkeypatch.setattr(tree, "_GAP_STEP", 10)
    xml = tree.rebuild(flat_frame(spark, [("d", "r:a[95]:@i", "1")]), None).first().xml
    assert xml == "<r>" + "<a />" * 95 + '<a i="1" /></r>'


names = st.sampled_from(["a", "b", "ab", "Z"])
texts = st.text(alphabet="xy <&>\"'\u00e9\u4e2d", max_size=6)


def element(children):
    return st.tuples(names, st.dictionaries(names, texts, max_size=2), texts, st.lists(children, max_size=4))


trees = st.recursive(st.tuples(names, st.dictionaries(names, texts, max_size=2), texts, st.just([])), element, max_leaves=8)


def to_xml(t):
    e = ET.Element(t[0], t[1])
    e.text = t[2]
    for c in t[3]:
        e.append(to_xml(c))
    return e


def flat_by_hand(e, path, out):
    for k, v in e.attrib.items():
        out[f"{path}:@{k}"] = v
    if e.text and e.text.strip():
        out[f"{path}:#text"] = e.text.strip()
    seen = {}
    for c in e:
        seen[c.tag] = seen.get(c.tag, -1) + 1
        flat_by_hand(c, f"{path}:{c.tag}[{seen[c.tag]}]", out)
    return out


@settings(max_examples=4, deadline=None)
@given(st.lists(trees, min_size=5, max_size=12))
def test_round_trip(spark, made):
    texts = [ET.tostring(to_xml(t), encoding="unicode") for t in made]
    before = tree.flatten(tree.nodes(docs(spark, *texts))).cache()
    want = sorted((f"d{i}", k, v) for i, t in enumerate(made) for k, v in flat_by_hand(to_xml(t), t[0], {}).items())
    assert pairs(before) == want
    after = tree.flatten(tree.nodes(tree.rebuild(before).select("doc_id", "xml")))
    assert pairs(after) == want


def test_compare(spark):
    left, right = flat_frame(spark, [("d", "a", "1"), ("d", "b", "2")]), flat_frame(spark, [("d", "a", "1"), ("d", "b", "3")])
    assert {(r.value, r.surplus) for r in tree.compare(left, right).filter("surplus <> 0").collect()} == {("2", 1), ("3", -1)}


def test_write_documents(spark, tmp_path, monkeypatch):
    flat = flat_frame(spark, KEYS)
    tree.write_documents(flat, str(tmp_path / "out"), None)
    found = {r.doc_id: r.xml for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: v.split("\n", 1)[1].rstrip() for k, v in found.items()} == REBUILT
    assert all(v.startswith(tree.XML_DECLARATION) for v in found.values())


def test_json(spark, tmp_path):
    rows = [("a", f"k{i:02}", f"v\u00e9{i}") for i in range(10)] + [("b", "x", '"q"')]
    objects = tree.to_json_objects(flat_frame(spark, rows)).collect()
    assert all(r.json.isascii() and len(json.loads(r.json)) == r.n_items for r in objects)
    got = {r.doc_id: json.loads(r.json) for r in objects}
    assert got == {"a": {f"k{i:02}": f"v\u00e9{i}" for i in range(10)}, "b": {"x": '"q"'}} and len(objects) == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text('{\n "p": "1",\n "q": "\\u00e9"\n}')
    assert sorted((r.path, r.value) for r in tree.read_flat_json(spark, str(tmp_path / "in")).collect()) == [
        ("p", "1"), ("q", "\u00e9"),
    ]
    tree.write_flat_json(flat_frame(spark, rows), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_json_quarantine(spark):
    docs = spark.createDataFrame([("a", '{"x": "1"}'), ("b", '{"x": "1"'), ("c", None), ("d", "")], "doc_id string, json string")
    assert {r.doc_id: r.error for r in tree.json_quarantine(docs).collect()} == {
        "b": "not a JSON object", "c": "no text", "d": "not a JSON object",
    }
    assert {r.doc_id for r in tree.from_json_objects(docs).collect()} == {"a"}


NEAR = [
    ("n", "r:a[2]:b[1]:c[3]:@k", "1"), ("n", "r:a[2]:b[1]:c[3]:@k", "2"), ("n", "r:a[2]:b[1]:#text", "t"), ("n", "r:a[2]:b[1]:#text", "s"),
    ("n", "r:ab[1]:x[0]", "1"), ("n", "r:a[2]:b[3]", None), ("n", "r:a[3]:@n", None), ("n", "r:a[3]:@m", ""), ("n", "r:a[1]:d[0]:e[0]:#text", "<"),
    ("n", "r:#text", "top"), ("n", "r:a[02]:@z", "q"), ("one", "r:#text", "x"), (None, "r:a[1]:@k", "v"),
]


def test_rebuild_from_neighbours(spark, monkeypatch):
    """Ends, gaps and starts between pairs of different depth, and one shuffle for all of it."""
    flat = flat_frame(spark, NEAR)
    built = tree.rebuild(flat, None)
    assert {r.doc_id: r.xml for r in built.collect()} == {
        "n": '<r>top<a /><a><d><e>&lt;</e></d></a><a z="q"><b /><b>t<c /><c /><c /><c k="2" /></b><b /><b /></a><a m="" /><ab /><ab><x /></ab></r>',
        "one": "<r>x</r>", None: '<r><a /><a k="v" /></r>',
    }
    staged = []
    monkeypatch.setattr(tree, "staged", lambda df: staged.append(df) or df)
    assert tree.rebuild(flat, None)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and not staged
