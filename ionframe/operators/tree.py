"""XML documents as element rows, as flat ``path -> value`` pairs, and back to XML.

A flat key is ``root:tag[i]:tag[j]:@attribute`` or ``...:#text``; ``i`` counts the siblings of one tag. The
order between differently named siblings and the whitespace around text are not kept in the flat form.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionframe import schemas
from ionframe.functions import columns as C
from ionframe.operators import grouping
from ionframe.session import staged
from ionframe.sources.xmltext import parse_batches

# Fixed value: the namespace put on rebuilt documents unless another is asked for.
DEFAULT_NAMESPACE = "http://psi.hupo.org/ms/mzml"
XML_DECLARATION = "<?xml version='1.0' encoding='utf-8'?>\n"
_GAP_STEP = 10_000


def read_documents(spark: SparkSession, paths) -> DataFrame:
    """Whole files as ``(doc_id, xml)``, the content as bytes so that a declared encoding is honoured."""
    return (
        spark.read.format("binaryFile")
        .load(paths)
        .select(F.col("_metadata.file_path").alias("doc_id"), F.col("content").alias("xml"))
    )


def nodes(docs: DataFrame, doc_id: str = "doc_id", xml: str = "xml") -> DataFrame:
    """One row per element; a document that does not parse gives one row with ``error``. No shuffle."""
    pairs = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(xml).alias("xml"))
    return pairs.mapInArrow(parse_batches, schemas.TREE_NODES)


def quarantine(tree: DataFrame) -> DataFrame:
    """The documents that did not parse, and why."""
    return tree.filter(F.col("error").isNotNull()).select("doc_id", "error")


def sibling_index(tree: DataFrame) -> DataFrame:
    """Add ``sibling_index``: the zero-based place among same-tag siblings, in document order.

    Siblings are grouped by their full tag. A parent may have very many children, so the numbering is the
    skew-safe one, cut by position.
    """
    split = F.floor(F.col("pos") / F.lit(grouping.PIECE_ROWS))
    return grouping.ordinal(tree, ["doc_id", "parent_id", "tag"], ["pos"], "sibling_index", split)


def flatten(tree: DataFrame) -> DataFrame:
    """Element rows to ``(doc_id, path, value)``: every attribute, and every text that is not blank. No shuffle."""
    text = C.strip(F.col("text"))
    attributes = F.transform(
        "attrs",
        lambda a: F.struct(
            F.concat("path", F.lit(C.SEPARATOR + C.ATTRIBUTE), a["name"]).alias("path"), a["value"].alias("value")
        ),
    )
    own_text = F.struct(F.concat("path", F.lit(C.SEPARATOR + C.TEXT)).alias("path"), text.alias("value"))
    pairs = F.when(F.length(text) > 0, F.array_append(attributes, own_text)).otherwise(attributes)
    return tree.filter(F.col("error").isNull()).select("doc_id", F.inline(pairs))


def item_counts(flat: DataFrame) -> DataFrame:
    return flat.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"))


# --- flat pairs as JSON ---------------------------------------------------------------------------------


def from_json_objects(docs: DataFrame, doc_id: str = "doc_id", text: str = "json") -> DataFrame:
    """JSON objects of strings, one per document, to ``(doc_id, path, value)``. ``json_quarantine`` has the documents
    that are none."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.explode(F.from_json(text, "map<string,string>")).alias("path", "value")
    )


def json_quarantine(docs: DataFrame, doc_id: str = "doc_id", text: str = "json") -> DataFrame:
    """The documents that are not a JSON object, as ``(doc_id, error)``; they give no pairs."""
    bad = F.from_json(text, "map<string,string>").isNull()
    error = F.when(F.col(text).isNull(), "no text").otherwise("not a JSON object")
    return docs.filter(bad).select(F.col(doc_id).alias("doc_id"), error.alias("error"))


def to_json_objects(flat: DataFrame) -> DataFrame:
    """One JSON object per document, keys in order, non-ASCII characters escaped. Of values under one key the greatest
    stays: the flat form keeps no order."""
    packed = grouping.pack(flat, ["doc_id"], ["path"], ["value"]).withColumn("items", _last_of_each("items", "path"))
    return packed.select(
        "doc_id",
        F.size("items").alias("n_items"),
        F.to_json(F.map_from_entries("items"), {"writeNonAsciiCharacterAsCodePoint": "true"}).alias("json"),
    )


def _last_of_each(items: str, key: str) -> Column:
    """Of sorted entries the last one of each key."""
    after = lambda i: F.get(F.col(f"{items}.{key}"), i + 1)
    return F.filter(items, lambda e, i: ~after(i).eqNullSafe(e[key]))


# --- flat pairs back to XML -----------------------------------------------------------------------------

# A document is rebuilt by sorting its pieces, not by building it bottom-up. The sort key of an element is the
# concatenation of one step per level: a mark, the tag, a mark, the index as '0' and nine digits, or '1' and eighteen
# where nine do not hold it. The marks order what comes inside an element and sort before every character of a tag.
_IN_ATTRIBUTE, _IN_BODY, _IN_CHILD, _IN_END, _AFTER_NAME = "\x01", "\x02", "\x03", "\x04", "\x01"

# The parts of a flat key that name elements. An index is a 64-bit number: eighteen digits after its zeros.
_ROOT = r"^[^:]+"
_ELEMENT = r":(?!#text\[)[^:@][^:]*\[0*[0-9]{1,18}\]"


def parse_keys(flat: DataFrame) -> DataFrame:
    """Add to each pair what its key says.

    ``kind`` is what the last segment denotes, ``name`` the attribute's name; ``key`` is the sort key of the
    last element that the key names before a malformed segment, if any; ``malformed`` marks keys that cannot
    be placed whole. Everything is a string function over the whole key, so it stays in generated code.
    """
    path = F.col("path")
    first = F.substring_index(path, C.SEPARATOR, 1)
    named = F.regexp_extract(path, f"{_ROOT}(?:{_ELEMENT})*(?=:|$)", 0)
    roots = flat.withColumns({"_first": first, "_named": named})
    # A bad root is kept alone, so that the document is seen to have it.
    good = C.is_good_root(F.col("_first"))
    elements = F.when(good, F.col("_named")).when(C.names_root(F.col("_first")), F.col("_first"))
    placed = roots.withColumns({"_good": good, "_elements": elements})
    rest = F.substring(path, F.length("_elements") + 1, F.length(path))
    # 'root:a[7]' -> mark root mark 0000000000 mark a mark 0000000007. The named elements end in their indexes.
    steps = F.array_join(F.transform(F.slice(F.split("_elements", C.SEPARATOR, -1), 2, 2**30), _step_of_segment), "")
    key = F.concat(F.lit(_IN_CHILD), "_first", F.lit(_AFTER_NAME + "0000000000"), steps)
    split = placed.withColumns({"_rest": rest, "key": F.when(F.col("_elements").isNotNull(), key)})
    is_last = F.length("_rest") - F.length(F.replace("_rest", F.lit(C.SEPARATOR), F.lit(""))) == 1
    kind = (
        F.when(~F.col("_good") | F.col("_elements").isNull(), "malformed")
        .when(F.col("_rest") == "", "element")
        .when(is_last & F.col("_rest").startswith(C.SEPARATOR + C.ATTRIBUTE), "attribute")
        .when(F.col("_rest") == C.SEPARATOR + C.TEXT, "text")
        .otherwise("malformed")
    )
    return split.withColumn("kind", kind).select(
        *flat.columns,
        "kind",
        F.when(F.col("kind") == "attribute", F.substring("_rest", 3, F.length("_rest"))).alias("name"),
        "key",
        (F.col("kind") == "malformed").alias("malformed"),
    )


def malformed_keys(flat: DataFrame) -> DataFrame:
    """Pairs whose key cannot be placed in a tree."""
    return _only(parse_keys(flat), F.col("malformed"), "doc_id", "path", "value")


def _only(df: DataFrame, condition: Column, *columns) -> DataFrame:
    """``filter`` and ``select`` as one generator. A plain filter on columns computed from the key would be moved
    below their computation and so compute them once more per mention."""
    return df.select(F.inline(F.when(condition, F.array(F.struct(*columns)))))


def root_check(flat: DataFrame) -> DataFrame:
    """Per document: the root its keys name, when they name one, and a status ('ok' or what is wrong).

    Keys that start with an attribute or text segment name no root. A root must not carry an index.
    """
    first = F.get(C.segments(F.col("path")), F.lit(0))
    root = F.when(C.names_root(first), first)
    # Distinct first: that is combined by hashing before its shuffle. Then the two extremes are enough to see
    # whether there is more than one root.
    distinct = flat.select("doc_id", root.alias("_root")).distinct()
    per_doc = distinct.groupBy("doc_id").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi"))
    return per_doc.select(
        "doc_id",
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("root"),
        _root_status(F.col("_lo"), F.col("_hi")).alias("status"),
    )


def _root_status(low: Column, high: Column) -> Column:
    return (
        F.when(low.isNull(), "no_root")
        .when(low != high, "multiple_roots")
        .when(C.is_good_root(low), "ok")
        .otherwise("bad_root")
    )


def _level(key: Column) -> Column:
    return F.length(key) - F.length(F.replace(key, F.lit(_IN_CHILD), F.lit("")))


def _step_key(tag: Column, index: Column) -> Column:
    digits = index.cast("string")
    short = F.concat(F.lit("0"), F.lpad(digits, 9, "0"))
    code = F.when(index < 10**9, short).otherwise(F.concat(F.lit("1"), F.lpad(digits, 18, "0")))
    return F.concat(F.lit(_IN_CHILD), tag, F.lit(_AFTER_NAME), code)


def _step_of_segment(segment: Column) -> Column:
    """The step of an indexed segment of a flat key."""
    last = F.substring_index(segment, "[", -1)
    tag = F.substring(segment, F.lit(1), F.length(segment) - F.length(last) - 1)
    return _step_key(tag, F.rtrim(last, F.lit("]")).cast("bigint"))


def elements(keyed: DataFrame) -> DataFrame:
    """Every element the keys name or imply, once: its sort ``key``, ``parent`` key, ``tag``, ``idx``, and
    whether it has text or children. Keys are combined before the shuffle, so a root named by every key of a
    large document costs one row per task."""
    depth = _level(F.col("key"))
    has_text = (F.col("kind") == "text") & (F.length("value") > 0)
    # A null key gives a null sequence, and that no rows.
    levels = keyed.select(
        "doc_id", "key", has_text.alias("_text"), depth.alias("_depth"), F.explode(F.sequence(F.lit(1), depth)).alias("_at")
    )
    at, own = F.col("_at"), F.col("_at") == F.col("_depth")
    named = (
        levels.select(
            "doc_id",
            F.when(own, F.col("key")).otherwise(_first_steps(F.col("key"), at)).alias("key"),
            (~own).alias("_child"),
            (own & F.col("_text")).alias("_text"),
        )
        .groupBy("doc_id", "key")
        .agg(F.max("_child").alias("has_child"), F.max("_text").alias("has_text"))
    )
    return named.select("doc_id", "key", *_places(), "has_child", "has_text")


def _places() -> list[Column]:
    """The parent's key, the tag and the index that a sort key names."""
    step = F.substring_index("key", _IN_CHILD, -1)
    parent = F.substring(F.col("key"), F.lit(1), F.length("key") - F.length(step) - 1)
    return [parent.alias("parent"), _step_tag(step).alias("tag"), _step_index(step).alias("idx")]


def _first_steps(key: Column, n: Column) -> Column:
    """The first ``n`` steps of a sort key."""
    return F.call_function("substring_index", key, F.lit(_IN_CHILD), n + 1)


def _sibling_groups(named: DataFrame) -> DataFrame:
    """Per parent and tag, the largest index and the number of elements there are."""
    return named.groupBy("doc_id", "parent", "tag").agg(
        F.max("idx").cast("bigint").alias("_max"), F.count(F.lit(1)).alias("_count")
    )


def _holed(named: DataFrame) -> DataFrame:
    """The sibling groups in which an index is absent below the largest."""
    return _sibling_groups(named).filter(F.col("_max") + 1 > F.col("_count"))


def fill_gaps(named: DataFrame, holed: DataFrame | None = None) -> DataFrame:
    """The empty elements that missing indexes stand for: below the largest index of a tag, none may be absent.

    Only groups with a hole (``holed``, where they are known) are expanded, in steps, so a huge index never becomes one huge array.
    """
    holed = _holed(named) if holed is None else holed
    blocks = holed.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor(F.col("_max") / _GAP_STEP))))
    low = F.col("_block") * _GAP_STEP
    every = blocks.select(
        "doc_id",
        "parent",
        "tag",
        F.explode(F.sequence(low, F.least(low + _GAP_STEP - 1, F.col("_max")))).alias("idx"),
    )
    missing = every.join(named.select("doc_id", "parent", "tag", "idx"), ["doc_id", "parent", "tag", "idx"], "left_anti")
    return missing.select(
        "doc_id",
        F.concat("parent", _step_key(F.col("tag"), F.col("idx"))).alias("key"),
        "parent",
        "tag",
        "idx",
        F.lit(False).alias("has_child"),
        F.lit(False).alias("has_text"),
    )


def _closed(steps: Column, kept: Column, text: Column) -> Column:
    """What closes the elements of a split sort key below its first ``kept`` steps, the last of them first; ``text`` tells whether that
    one has its '>' already."""
    end = lambda s: F.concat(F.lit("</"), _step_tag(s), F.lit(">"))
    above = F.slice(steps, kept + 1, F.size(steps) - kept - 1)
    return F.concat(F.when(text, end(F.element_at(steps, -1))).otherwise(F.lit(" />")), F.array_join(F.transform(F.reverse(above), end), ""))


def _between(before: Column, text: Column, key: Column, declared: str) -> Column:
    """The markup between what belongs to the element ``before`` and what belongs to the next one, ``key``: ends, the empty elements that
    missing indexes stand for, and starts. The start tag of ``before`` is open, unless it has a ``text``, and that of ``key`` stays open."""

    def markup(steps: Column, kept: Column) -> Column:
        old, new = steps["old"], steps["new"]

        def start(step: Column, place: Column) -> Column:
            tag, beside = _step_tag(step), F.get(old, kept + place)
            first = F.when((place == 0) & (_step_tag(beside) == tag), _step_index(beside) + 1).otherwise(F.lit(0))
            missing = F.repeat(F.concat(F.lit("<"), tag, F.lit(" />")), (_step_index(step) - first).cast("int"))
            root = F.when(kept + place == 1, F.lit(declared)).otherwise(F.lit(""))
            last = place == F.size(new) - kept - 1
            return F.concat(missing, F.lit("<"), tag, root, F.when(last, F.lit("")).otherwise(F.lit(">")))

        inside = F.when(text | before.isNull(), F.lit("")).otherwise(F.lit(">"))
        ends = F.when(F.size(old) == kept, inside).otherwise(_closed(old, kept, text))
        return F.concat(ends, F.array_join(F.transform(F.slice(new, kept + 1, F.size(new) - kept), start), ""))

    # A sort key begins with a mark, so that all split keys have an empty first step in common.
    split = F.struct(*[F.split(F.coalesce(k, F.lit("")), _IN_CHILD, -1).alias(n) for k, n in ((before, "old"), (key, "new"))])
    kept = lambda s: F.array_position(F.zip_with(s["old"], s["new"], lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int") - 1
    return F.when(key == before, F.lit("")).otherwise(C.let(split, lambda s: C.let(kept(s), lambda n: markup(s, n))))


def _step_tag(step: Column) -> Column:
    return F.substring_index(step, _AFTER_NAME, 1)


def _step_index(step: Column) -> Column:
    return F.substring(F.substring_index(step, _AFTER_NAME, -1), 2, 18).cast("bigint")


def rebuild(flat: DataFrame, namespace: str | None = DEFAULT_NAMESPACE) -> DataFrame:
    """Rebuilt documents as ``(doc_id, xml)``, one row each whatever their size, without the XML declaration.

    Children come in tag order and then index order, attributes in name order. Documents whose keys do not agree on one good
    root are left out; ``root_check`` names them. Of values under one key the greatest stays.

    One shuffle of the pairs: in the order of their sort keys, each pair and the one before it tell what lies between them.
    """
    keyed = parse_keys(flat.repartition("doc_id"))
    is_text = (F.col("kind") == "text") & (F.length("value") > 0)
    attribute = F.concat(F.lit(" "), F.col("name"), F.lit('="'), C.xml_escape_attribute(F.col("value")), F.lit('"'))
    entry = F.struct(
        "key",
        F.when(is_text, F.lit(_IN_BODY)).when(F.col("kind") == "attribute", F.concat(F.lit(_IN_ATTRIBUTE), "name")).otherwise(F.lit("")).alias("own"),
        F.when(is_text, F.concat(F.lit(">"), C.xml_escape_text(F.col("value")))).when(F.col("kind") == "attribute", attribute).alias("xml"),
    )
    # The id stays outside of the generator, or Spark would not know that the rows lie by it.
    rows = keyed.select("doc_id", F.inline(F.when(F.col("key").isNotNull(), F.array(entry))))
    order = Window.partitionBy("doc_id").orderBy("key", "own", "xml")
    near = rows.select(
        "*",
        F.row_number().over(order).alias("_n"),
        F.lag("key").over(order).alias("_before"),
        F.lag("own").over(order).alias("_before_own"),
        F.lead("key").over(order).alias("_after"),
        F.lead("own").over(order).alias("_after_own"),
    )
    declared = f' xmlns="{namespace}"' if namespace else ""
    repeated = (F.col("_after") == F.col("key")) & (F.col("_after_own") == F.col("own"))
    steps = F.split("key", _IN_CHILD, -1)
    xml = F.concat(
        _between(F.col("_before"), F.coalesce(F.col("_before_own") == _IN_BODY, F.lit(False)), F.col("key"), declared),
        F.when(repeated, F.lit("")).otherwise(F.coalesce("xml", F.lit(""))),
        F.when(F.col("_after").isNull(), _closed(steps, F.lit(1), F.col("own") == _IN_BODY)).otherwise(F.lit("")),
    )
    root = _step_tag(F.substring_index(F.substring("key", 2, 2**30), _IN_CHILD, 1))
    return (
        near.select("doc_id", F.struct("_n", xml.alias("xml")).alias("item"), root.alias("_root"))
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list("item")).alias("items"), F.min("_root").alias("_lo"), F.max("_root").alias("_hi"))
        .filter(_root_status(F.col("_lo"), F.col("_hi")) == "ok")
        .select("doc_id", F.array_join("items.xml", "").alias("xml"))
    )


def write_documents(flat: DataFrame, path: str, namespace: str | None = DEFAULT_NAMESPACE) -> None:
    """Rebuilt documents with their declaration as Parquet rows ``(doc_id, xml)``, ordered by document."""
    xml = F.concat(F.lit(XML_DECLARATION), "xml").alias("xml")
    rebuild(flat, namespace).select("doc_id", xml).repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(path)


def document_lines(flat: DataFrame, namespace: str | None = DEFAULT_NAMESPACE) -> DataFrame:
    """The rebuilt documents with their declaration as ``(doc_id, key, line)``: in ``key`` order, with '>' behind each, the lines read
    as the document. A line is a tag or a text with the tag after it, so none holds more than one element's own values.

    A text that children follow ends in an empty comment, because only markup ends in '>'; otherwise the documents are those of
    ``rebuild``.
    """
    is_text = (F.col("kind") == "text") & (F.length("value") > 0)
    pair = F.struct("name", F.concat(F.lit(" "), "name", F.lit('="'), C.xml_escape_attribute(F.col("value")), F.lit('"')).alias("xml"))
    # The keys are parsed once. The elements above those that have pairs meet the pairs in one shuffle, and what follows works on a row per element.
    keyed = staged(
        _only(
            parse_keys(flat), F.col("key").isNotNull(), "doc_id", "key",
            F.when(F.col("kind") == "attribute", pair).alias("pair"), F.when(is_text, C.xml_escape_text(F.col("value"))).alias("text"),
        )
    )
    depth = _level(F.col("key"))
    levels = keyed.where(depth > 1).select("doc_id", "key", F.explode(F.sequence(F.lit(1), depth - 1)).alias("_at"))
    above = levels.select("doc_id", _first_steps(F.col("key"), F.col("_at")).alias("key")).distinct().withColumn("has_child", F.lit(True))
    attributes = F.array_join(F.transform(_last_of_each("pairs", "name"), lambda a: a["xml"]), "")
    named = staged(
        keyed.unionByName(above, allowMissingColumns=True)
        .groupBy("doc_id", "key")
        .agg(F.array_sort(F.collect_list("pair")).alias("pairs"), F.max("text").alias("text"), F.coalesce(F.max("has_child"), F.lit(False)).alias("has_child"))
        .select("doc_id", "key", *_places(), "has_child", F.col("text").isNotNull().alias("has_text"), "text", attributes.alias("attributes"))
    )
    holed = staged(_holed(named))
    everything = named if holed.isEmpty() else named.unionByName(fill_gaps(named, holed), allowMissingColumns=True)
    at_root = F.col("parent") == ""
    roots = everything.filter(at_root).groupBy("doc_id").agg(F.min("tag").alias("_lo"), F.max("tag").alias("_hi"))
    good = roots.filter(_root_status(F.col("_lo"), F.col("_hi")) == "ok").select("doc_id")

    def line(mark: str, *parts) -> Column:
        return F.struct(F.concat("key", F.lit(mark)).alias("key"), F.concat(*parts).alias("line"))

    declared = f' xmlns="{namespace}"' if namespace else ""
    has_child, has_text = F.col("has_child"), F.col("has_text")
    start = line(
        "", F.when(at_root, F.lit(XML_DECLARATION + "<")).otherwise(F.lit("<")), F.col("tag"), F.when(at_root, F.lit(declared)).otherwise(F.lit("")),
        F.coalesce("attributes", F.lit("")), F.when(has_child | has_text, F.lit("")).otherwise(F.lit(" /")),
    )
    text = line(_IN_BODY, F.col("text"), F.when(has_child, F.lit("<!----")).otherwise(F.concat(F.lit("</"), "tag")))
    end = line(_IN_END, F.lit("</"), F.col("tag"))
    lines = F.when(has_child & has_text, F.array(start, text, end)).when(has_child, F.array(start, end)).when(has_text, F.array(start, text))
    rows = everything.select("doc_id", F.inline(F.coalesce(lines, F.array(start))))
    return rows.join(good, "doc_id", "left_semi")


def write_document_files(
    flat: DataFrame, path: str, namespace: str | None = DEFAULT_NAMESPACE, compression: str = "none"
) -> None:
    """Rebuilt documents as UTF-8 XML, a folder ``doc_id=...`` for each, whose files in name order are the document. ``compression`` is the
    codec of the files, if any.

    Documents are spread over tasks by their parts, so a large one is written by many; no document is ever one cell. A small
    one is one file, or two where a border between tasks falls in it. Null and empty ids name no folder and are left out.
    """
    _write_lines(document_lines(flat, namespace), path, ">", compression)


def _write_lines(lines: DataFrame, path: str, after_each: str, compression: str = "none") -> None:
    # Staged, because finding the ranges reads the lines once more.
    kept = staged(lines.filter(F.length("doc_id") > 0))
    rows = kept.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")
    rows.select("doc_id", "line").write.partitionBy("doc_id").option("lineSep", after_each).option("compression", compression).text(path)


def read_document_files(spark: SparkSession, path: str, text: str = "xml") -> DataFrame:
    """The documents of a folder that ``write_document_files`` or ``write_flat_json_files`` wrote, as ``(doc_id, <text>)``. Here a document
    is one cell."""
    files = spark.read.schema("value string, doc_id string").text(path, wholetext=True)
    parts = files.select("doc_id", F.col("_metadata.file_name").alias("name"), "value")
    return parts.groupBy("doc_id").agg(grouping.ordered_list(["name"], ["value"]).alias("items")).select(
        "doc_id", F.array_join("items.value", "").alias(text)
    )


def write_flat_json_files(flat: DataFrame, path: str) -> None:
    """One flat JSON object per document, its keys in order, as UTF-8 files laid out as by ``write_document_files``. Of values under one
    key the greatest stays; documents without pairs have no file."""
    once = flat.groupBy("doc_id", "path").agg(F.max("value").alias("value"))
    first = once.groupBy("doc_id").agg(F.min("path").alias("path")).withColumn("_first", F.lit(True))
    pair = F.to_json(F.create_map("path", "value"), {"writeNonAsciiCharacterAsCodePoint": "true", "ignoreNullFields": "false"})
    opening = F.when(F.col("_first"), F.lit("{")).otherwise(F.lit(","))
    pairs = once.join(first, ["doc_id", "path"], "left").select(
        "doc_id", F.struct(F.lit(0).alias("end"), "path").alias("key"), F.concat(opening, F.substring(pair, F.lit(2), F.length(pair) - 2)).alias("line")
    )
    ends = first.select("doc_id", F.struct(F.lit(1).alias("end"), F.lit("").alias("path")).alias("key"), F.lit("}").alias("line"))
    _write_lines(pairs.unionByName(ends), path, "\n")


def read_flat_json(spark: SparkSession, paths) -> DataFrame:
    """Files that each hold one flat JSON object, as ``(doc_id, path, value)``."""
    files = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("json")
    )
    return from_json_objects(files)


def write_flat_json(flat: DataFrame, path: str) -> None:
    """One flat JSON object per document as Parquet rows ``(doc_id, n_items, json)``, ordered by document."""
    to_json_objects(flat).repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(path)


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every distinct pair of either side with how often ``left`` has it and by how much more than ``right``.

    Both sides hold the same pairs when no ``surplus`` differs from 0. One shuffle, combined before it.
    """
    signed = left.select("doc_id", "path", "value", F.lit(1).alias("_s")).unionByName(
        right.select("doc_id", "path", "value", F.lit(-1).alias("_s"))
    )
    return signed.groupBy("doc_id", "path", "value").agg(
        F.count_if(F.col("_s") > 0).alias("n_left"), F.sum("_s").alias("surplus")
    )
