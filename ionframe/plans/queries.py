"""The registered queries: one per operator group, each over the driver's whole tables.

Results are rows of scalars under fixed names, so that any SQL engine can state the same result.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.functions import codec
from ionframe.functions import columns as C
from ionframe.operators import extract, grouping, layout, metadata, precursor, tree
from ionframe.plans import bridge
from ionframe.session import scratch_path, staged
from ionframe.sources import mzml, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The box most queries use: m/z 20000-25000, days 100-400. Ranges are given as (centre, tolerance).
MZ, MZ_TOL, RT, RT_TOL = 22_500.0, 2_500.0, 250.0, 150.0


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _double(*names: str) -> list:
    """Float columns as the double of the same value, so that no engine re-rounds them."""
    return [F.col(n).cast("double").alias(n) for n in names]


# --- boxes ----------------------------------------------------------------------------------------------


@query
def extract_box(spark, sf_dir):
    """Peaks of one m/z and RT box, on every MS level."""
    long = bridge.spectrum_peaks(spark, sf_dir, mz=(MZ - MZ_TOL, MZ + MZ_TOL), rt=(RT - RT_TOL, RT + RT_TOL))
    hits = extract.extract_box(long, MZ, MZ_TOL, RT, RT_TOL, (1, 2, 3))
    return hits.select("run_id", "id", "ms_level", *_double("rt", "mz", "intensity"))


@query
def extract_box_wide(spark, sf_dir):
    """The same box from the wide layout (m/z kept as float32, so that the edges agree)."""
    wide = bridge.wide_spectra(spark, sf_dir, mz_type="float", rt=(RT - RT_TOL, RT + RT_TOL), ms_levels=(1,))
    hits = extract.extract_box_wide(wide, MZ, MZ_TOL, RT, RT_TOL, 1)
    return hits.select("run_id", "id", "ms_level", *_double("rt", "mz", "intensity"))


@query
def wide_has_mz(spark, sf_dir):
    """Vectors with an element in a closed range."""
    hit = C.any_within(F.col("embedding"), 0.30, 0.31, "float")
    return bridge.vectors(spark, sf_dir).filter(hit).select("vec_id", "label", F.size("embedding").alias("n"))


@query
def wide_spectra_with_mz(spark, sf_dir):
    """Wide spectra of one level and RT window that have a peak in the m/z window."""
    wide = bridge.wide_spectra(spark, sf_dir, rt=(RT - RT_TOL, RT + RT_TOL), ms_levels=(2,))
    hits = extract.spectra_with_mz(wide, MZ, MZ_TOL, RT, RT_TOL, 2)
    return hits.select("id", "ms_level", "n_peaks", "mz_min", "mz_max")


def boxes() -> list[tuple]:
    """A hundred boxes from a fixed linear rule (a seeded random table would differ between engines)."""
    return [
        (i, i % 3 + 1, 1000.0 + (i * 7919) % 100_000, 50.0, float((i * 104_729) % 2400), 60.0)
        for i in range(100)
    ]


def _box_hits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    table = extract.box_table(spark, boxes()).drop("run_id")
    return extract.extract_boxes(bridge.spectrum_peaks(spark, sf_dir), table, 100.0, 120.0), table


@query
def extract_boxes_batch(spark, sf_dir):
    """A hundred boxes in one job."""
    hits, _ = _box_hits(spark, sf_dir)
    return hits.select("box_id", "id", "ms_level", *_double("rt", "mz", "intensity"))


@query
def box_mean_hits(spark, sf_dir):
    """Mean number of peaks per box and level; empty boxes count as zero."""
    hits, table = _box_hits(spark, sf_dir)
    per_box = extract.hits_per_box(hits, table).join(table, "box_id")
    return per_box.groupBy("ms_level").agg(
        F.count(F.lit(1)).alias("n_boxes"),
        F.sum("n_hits").alias("n_hits"),
        F.round(F.avg("n_hits"), 6).alias("mean_hits"),
    )


# --- filters and fetches --------------------------------------------------------------------------------


@query
def random_boxes(spark, sf_dir):
    """Boxes drawn over the ranges of the whole peak table, and what each of them finds."""
    drawn = extract.random_boxes(spark, 200, 2, mz=(1_000.0, 100_000.0), rt=(0.0, 2_400.0), mz_tol=500.0, rt_tol=60.0)
    hits = extract.extract_boxes(bridge.spectrum_peaks(spark, sf_dir, ms_levels=(2,)), drawn)
    return drawn.select("box_id", "ms_level", "mz", "rt").join(extract.hits_per_box(hits, drawn), "box_id")


def _summary(df: DataFrame) -> DataFrame:
    """Per MS level: rows, spectra, and the extent of what was selected."""
    return df.groupBy("ms_level").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("id").alias("n_spectra"),
        F.min("mz").cast("double").alias("mz_lo"),
        F.max("mz").cast("double").alias("mz_hi"),
        F.sum(F.col("intensity").cast("double")).alias("sum_intensity"),
    )


@query
def filter_data_type(spark, sf_dir):
    """Rows per kind in the long table, and of the spectra among them."""
    return (
        _long_table(spark, sf_dir)
        .filter(F.col("data_type") == layout.SPECTRUM)
        .groupBy("data_type")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("intensity").cast("double")).alias("sum_intensity"))
    )


@query
def rt_window(spark, sf_dir):
    lo, hi = RT - RT_TOL, RT + RT_TOL
    long = bridge.spectrum_peaks(spark, sf_dir, rt=(lo, hi))
    return _summary(long.filter(C.around(F.col("rt"), RT, RT_TOL)))


@query
def mz_window(spark, sf_dir):
    lo, hi = MZ - MZ_TOL, MZ + MZ_TOL
    long = bridge.spectrum_peaks(spark, sf_dir, mz=(lo, hi))
    return _summary(long.filter(C.around(F.col("mz"), MZ, MZ_TOL)))


@query
def ms_level_filter(spark, sf_dir):
    """Level equality on the long table; chromatogram rows have no level and never match."""
    long = _long_table(spark, sf_dir)
    return _summary(long.filter(F.col("ms_level") == F.lit(2).cast("byte")))


FETCH_IDS = [f"scan={i}" for i in (0, 1, 7, 42, 100, 333, 999, 1234)]


@query
def fetch_by_ids(spark, sf_dir):
    rows = extract.fetch_by_ids(bridge.spectrum_peaks(spark, sf_dir), FETCH_IDS)
    return rows.select("id", "ms_level", *_double("rt", "mz", "intensity"))


@query
def fetch_sampled(spark, sf_dir):
    """All peaks of 100 spectra, sampled by a plain arithmetic hash."""
    number = F.substring(F.col("id"), 6, 20).cast("bigint")
    rank = (number * F.lit(7919) + F.lit(13)) % F.lit(1_000_003)
    ids = bridge.spectra(spark, sf_dir).select("run_id", "id")
    rows = extract.fetch_sampled(bridge.spectrum_peaks(spark, sf_dir), ids, 100, rank)
    return rows.select("id", "ms_level", *_double("rt", "mz", "intensity"))


@query
def distinct_ids(spark, sf_dir):
    return layout.distinct_ids(bridge.spectrum_peaks(spark, sf_dir))


@query
def count_spectra(spark, sf_dir):
    ids = layout.distinct_ids(bridge.spectrum_peaks(spark, sf_dir))
    return ids.agg(F.count("id").alias("n_spectra"), (F.count("id") >= 100).alias("enough"))


# --- layouts --------------------------------------------------------------------------------------------


def _long_table(spark, sf_dir) -> DataFrame:
    """Spectra and chromatograms in one table. Both come from tables that are long already."""
    points = bridge.chromatogram_points(spark, sf_dir).select(
        "run_id",
        "id",
        F.lit(layout.CHROMATOGRAM).alias("data_type"),
        F.col("time").cast("float").alias("rt"),
        F.col("product_mz").alias("mz"),
        F.col("intensity").cast("float").alias("intensity"),
    )
    return bridge.spectrum_peaks(spark, sf_dir).unionByName(points, allowMissingColumns=True)


@query
def wide_to_long(spark, sf_dir):
    """Wide spectra exploded to peak rows, with the peak's place in its spectrum."""
    long = layout.spectra_to_long(bridge.wide_spectra(spark, sf_dir))
    return long.select("id", "data_type", "ms_level", "peak_index", *_double("rt", "mz", "intensity", "ion_mobility"))


@query
def long_to_wide(spark, sf_dir):
    """Peak rows packed to arrays; arrays are shown by size, ends, a sum, and sums weighted by place."""
    wide = bridge.wide_spectra(spark, sf_dir)
    return wide.select(
        "id",
        "ms_level",
        *_double("rt"),
        "n_peaks",
        F.try_element_at("mz_array", F.lit(1)).alias("mz_first"),
        F.try_element_at("mz_array", F.lit(-1)).alias("mz_last"),
        "mz_min",
        "mz_max",
        F.aggregate("intensity_array", F.lit(0.0), lambda a, x: a + x).alias("sum_intensity"),
        _weighted("mz_array", 100).alias("mz_weighted"),
        _weighted("intensity_array", 1).alias("intensity_weighted"),
    )


@query
def chrom_wide(spark, sf_dir):
    wide = bridge.wide_chromatograms(spark, sf_dir)
    return wide.select(
        "run_id",
        "id",
        "data_type",
        *_double("precursor_mz", "product_mz"),
        F.size("time_array").alias("n_points"),
        F.element_at("time_array", 1).alias("time_first"),
        F.element_at("time_array", -1).alias("time_last"),
        F.element_at("intensity_array", 1).cast("double").alias("intensity_first"),
        F.element_at("intensity_array", -1).cast("double").alias("intensity_last"),
        _weighted("time_array", 1_000_000).alias("time_weighted"),
        _weighted("intensity_array", 1000).alias("intensity_weighted"),
    )


@query
def chrom_to_long(spark, sf_dir):
    long = layout.chromatograms_to_long(bridge.wide_chromatograms(spark, sf_dir))
    return long.select(
        "id", "data_type", "ms_level", "peak_index", *_double("rt", "mz", "intensity", "ion_mobility")
    )


@query
def long_union(spark, sf_dir):
    """Both kinds of rows from the wide layout in one long table, summarised by kind and level."""
    long = layout.long_table(bridge.wide_spectra(spark, sf_dir), bridge.wide_chromatograms(spark, sf_dir))
    return long.groupBy("data_type", "ms_level").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("id").alias("n_ids"),
        F.count("ion_mobility").alias("n_mobility"),
        F.min("mz").cast("double").alias("mz_lo"),
        F.max("mz").cast("double").alias("mz_hi"),
    )


@query
def empty_spectra(spark, sf_dir):
    """Spectra that keep a wide row but give no long rows: headers without peaks, found without packing any."""
    empty = bridge.spectra(spark, sf_dir).join(bridge.peaks(spark, sf_dir), "scan_index", "left_anti")
    return empty.select("id", "ms_level", *_double("rt"), F.lit(0).alias("n_peaks"))


@query
def zip_truncate(spark, sf_dir):
    """Two arrays of unequal length paired up to the shorter one."""
    v = bridge.vectors(spark, sf_dir).withColumn("cut", F.slice("embedding", 1, F.col("label") * 5 + 3))
    pairs = C.zip_shortest(F.col("embedding"), F.col("cut"), "a", "b")
    return v.select("vec_id", F.posexplode(pairs).alias("pos", "p")).select(
        "vec_id", "pos", F.col("p.a").cast("double").alias("a"), F.col("p.b").cast("double").alias("b")
    )


@query
def array_stats(spark, sf_dir):
    return bridge.vectors(spark, sf_dir).select(
        "vec_id",
        F.size("embedding").alias("n"),
        F.array_min("embedding").cast("double").alias("lo"),
        F.array_max("embedding").cast("double").alias("hi"),
        F.element_at("embedding", 1).cast("double").alias("first"),
        F.element_at("embedding", -1).cast("double").alias("last"),
        _weighted("embedding", 1_000_000).alias("weighted"),
    )


@query
def narrow_casts(spark, sf_dir):
    """Narrow types, strict where every value fits and lenient where some do not."""
    items = bridge.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").cast("int").alias("qty"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_partkey").alias("part"),
    )
    narrowed = layout.narrow(items, {"line": "byte", "qty": "byte", "price": "float"})
    lenient = layout.narrow(narrowed, {"part": "byte"}, strict=False)
    return lenient.select("l_orderkey", "l_linenumber", "l_partkey", "line", "qty", *_double("price"), "part")


@query
def null_if_zero(spark, sf_dir):
    items = bridge.table(spark, sf_dir, "lineitem")
    return items.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(C.null_if_zero(F.col("l_tax"))).alias("n_taxed"),
        F.round(F.avg(C.null_if_zero(F.col("l_tax"))), 8).alias("mean_tax"),
    )


@query
def unit_normalize(spark, sf_dir):
    """Times given in minutes become seconds; others stay."""
    unit = F.when(F.col("event_type") == "click", C.UNIT_MINUTE).otherwise("UO:0000010")
    return bridge.table(spark, sf_dir, "events").select(
        "event_id", "event_type", C.to_seconds(F.col("value"), unit).alias("seconds")
    )


@query
def array_codec_roundtrip(spark, sf_dir):
    """Every vector encoded to base64 text (two widths, with and without zlib) and decoded again."""
    v = bridge.vectors(spark, sf_dir).withColumns({
        "bits": F.when(F.col("label") % 2 == 0, 32).otherwise(64),
        "zipped": F.col("label") % 3 == 0,
    })
    text = codec.encode_array(F.col("embedding"), F.col("bits"), F.col("zipped"))
    back = v.withColumn("text", text).withColumn(
        "decoded", codec.decode_array(F.col("text"), F.col("bits"), F.col("zipped"))
    )
    return back.select(
        "vec_id",
        "bits",
        F.size("decoded").alias("n"),
        F.element_at("decoded", 1).alias("first"),
        F.element_at("decoded", -1).alias("last"),
        (F.col("decoded") == F.col("embedding").cast("array<double>")).alias("same"),
    )


@query
def parquet_roundtrip_long(spark, sf_dir):
    """The long table written clustered, and read back."""
    path = scratch_path(spark, "long")
    tables.write_long(_long_table(spark, sf_dir), path)
    return tables.read_long(spark, path).groupBy("data_type", "ms_level").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("id").alias("n_ids"),
        F.min("mz").cast("double").alias("mz_lo"),
        F.max("mz").cast("double").alias("mz_hi"),
        F.sum(F.col("intensity").cast("double")).cast("decimal(20,2)").cast("double").alias("sum_intensity"),
    )


@query
def store_add_runs(spark, sf_dir):
    """The long table put into a growing store in three calls: half of the runs with wrong intensities, the other half, and the
    first half again as it should be. The runs are small and many, so each call is one batch."""
    path = scratch_path(spark, "growing")
    rows = _long_table(spark, sf_dir)
    first = F.pmod(F.xxhash64("run_id"), F.lit(2)) == 0
    tables.add_runs(rows.where(first).withColumn("intensity", F.lit(-1.0)), path, batches=True)
    tables.add_runs(rows.where(~first), path, batches=True)
    tables.add_runs(rows.where(first), path, batches=True)
    return tables.read_runs(spark, path, batches=True).groupBy("run_id", "data_type").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("id").alias("n_ids"),
        F.sum(F.col("mz").cast("double")).cast("decimal(20,2)").cast("double").alias("sum_mz"),
        F.sum(F.col("intensity").cast("double")).cast("decimal(20,2)").cast("double").alias("sum_intensity"),
    )


@query
def store_fetch_indexed(spark, sf_dir):
    """A store of the long table with an index, and 100 sampled spectra fetched by it; the index is shown by its size."""
    path = scratch_path(spark, "indexed")
    tables.write_long(_long_table(spark, sf_dir), path, index=True)
    long, index = tables.read_long(spark, path), tables.read_index(spark, path)
    some = [(r.run_id, r.id) for r in extract.sample_ids(index, 100, (F.substring("id", 6, 20).cast("long") * 7919 + 13) % 1000003).collect()]
    size = index.agg(F.count(F.lit(1)).alias("n_indexed"))
    rows = extract.fetch_indexed(long, index, some).select("run_id", "id", "ms_level", *_double("rt", "mz", "intensity"))
    return rows.join(F.broadcast(size), how="cross")  # one row


@query
def parquet_roundtrip_wide(spark, sf_dir):
    """Both wide tables written, and read back."""
    path = scratch_path(spark, "wide")
    tables.write_wide(bridge.wide_spectra(spark, sf_dir), bridge.wide_chromatograms(spark, sf_dir), path)
    spectra, chromatograms = tables.read_wide(spark, path)
    shown = lambda x, scale, y: (
        F.countDistinct("id").alias("n_ids"), F.sum(F.size(x)).alias("n_points"),
        F.sum(_weighted(x, scale)).alias("x_weighted"), F.sum(_weighted("intensity_array", y)).alias("y_weighted"),
    )
    return spectra.groupBy("data_type").agg(*shown("mz_array", 100, 1)).unionByName(
        chromatograms.groupBy("data_type").agg(*shown("time_array", 1000, 100))
    )


# --- precursors, labels ---------------------------------------------------------------------------------


@query
def precursor_asof(spark, sf_dir):
    """For each spectrum above level 1 the last earlier spectrum of its run one level below."""
    found = precursor.precursor_asof(bridge.spectra(spark, sf_dir))
    return found.select("run_id", "scan_index", "ms_level", "precursor_index", *_double("precursor_rt"))


@query
def scan_index(spark, sf_dir):
    """Spectra of each run numbered from zero in scan order."""
    numbered = grouping.ordinal(
        bridge.spectra(spark, sf_dir),
        ["run_id"],
        ["scan_index"],
        "number",
        F.floor(F.col("scan_index") / F.lit(grouping.PIECE_ROWS)),
    )
    return numbered.select("run_id", "id", "number")


@query
def precursor_fields(spark, sf_dir):
    items = bridge.table(spark, sf_dir, "lineitem")
    return items.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        *metadata.precursor_fields(
            F.col("l_extendedprice"), (F.col("l_partkey") % 4).cast("int"), F.col("l_tax")
        ),
    )


@query
def enum_labels(spark, sf_dir):
    """Order priorities through a partial vocabulary; the rest get the default label."""
    known = {"1-URGENT": "POSITIVE", "2-HIGH": "NEGATIVE"}
    return bridge.table(spark, sf_dir, "orders").select(
        "o_orderkey", C.label(F.col("o_orderpriority"), known).alias("label")
    )


# --- trees ----------------------------------------------------------------------------------------------


def _nodes(spark, sf_dir) -> DataFrame:
    return tree.nodes(bridge.xml_documents(spark, sf_dir))


def _flat(spark, sf_dir) -> DataFrame:
    return tree.flatten(_nodes(spark, sf_dir))


@query
def tree_nodes(spark, sf_dir):
    """Elements per tag and depth."""
    return _nodes(spark, sf_dir).groupBy(C.clean_tag(F.col("tag")).alias("tag"), "depth").agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.sum(F.size("attrs")).alias("n_attrs"),
        F.sum("pos").alias("sum_pos"),
    )


@query
def sibling_index(spark, sf_dir):
    """Place of each element among its same-tag siblings, by window over the stored position."""
    numbered = tree.sibling_index(staged(_nodes(spark, sf_dir).select("doc_id", "parent_id", "tag", "pos", "depth")))
    return numbered.select("doc_id", C.clean_tag(F.col("tag")).alias("tag"), "depth", "pos", "sibling_index")


@query
def tree_flatten(spark, sf_dir):
    return _flat(spark, sf_dir).select("doc_id", "path", "value")


@query
def tree_item_counts(spark, sf_dir):
    return tree.item_counts(_flat(spark, sf_dir))


@query
def clean_tag(spark, sf_dir):
    """Tags with and without a namespace, cleaned."""
    orders = bridge.table(spark, sf_dir, "orders")
    tag = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("{urn:doc}"), "o_orderpriority")).otherwise(
        F.col("o_orderpriority")
    )
    return orders.select("o_orderkey", C.clean_tag(tag).alias("tag"))


def _made_keys(spark, sf_dir) -> DataFrame:
    """Flat keys made from lineitem: some whole, some malformed, with gaps in the indexes; three documents
    in a hundred name two roots."""
    items = bridge.table(spark, sf_dir, "lineitem")
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    root = F.when((order % 100 < 3) & (line % 2 == 0), "other").otherwise("run")
    middle = F.when(F.col("l_partkey") % 10 == 0, "peak").otherwise(F.concat(F.lit("peak["), line, F.lit("]")))
    last = (
        F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("@p"), F.col("l_partkey")))
        .when(F.col("l_partkey") % 3 == 1, "#text")
        .otherwise(F.concat(F.lit("sub["), F.col("l_suppkey") % 5, F.lit("]")))
    )
    return items.select(
        order.cast("string").alias("doc_id"),
        F.concat_ws(":", root, middle, last).alias("path"),
        F.col("l_quantity").cast("int").cast("string").alias("value"),
    )


def _unique_keys(spark, sf_dir) -> DataFrame:
    """The made keys as maps have them: each key of a document once."""
    return _made_keys(spark, sf_dir).groupBy("doc_id", "path").agg(F.min("value").alias("value"))


@query
def key_parse(spark, sf_dir):
    """Distinct segments of the made keys with their tag and index."""
    segment = F.explode(C.segments(F.col("path"))).alias("segment")
    return _made_keys(spark, sf_dir).select(segment).groupBy("segment").agg(F.count(F.lit(1)).alias("n")).select(
        "segment", "n", C.segment_tag(F.col("segment")).alias("tag"), C.segment_index(F.col("segment")).alias("idx")
    )


@query
def key_classify(spark, sf_dir):
    """Segments by what they denote at their place in the key."""
    parts = C.segments(F.col("path"))
    return (
        _made_keys(spark, sf_dir)
        .select(F.size(parts).alias("n_parts"), F.posexplode(parts).alias("at", "segment"))
        .select(
            "at",
            C.segment_kind(F.col("segment"), F.col("at") == 0, F.col("at") == F.col("n_parts") - 1).alias("kind"),
        )
        .groupBy("at", "kind")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def key_malformed(spark, sf_dir):
    return tree.malformed_keys(_made_keys(spark, sf_dir))


@query
def tree_root_check(spark, sf_dir):
    return tree.root_check(_made_keys(spark, sf_dir))


@query
def tree_gap_fill(spark, sf_dir):
    """The empty elements that stand for missing indexes."""
    named = tree.elements(tree.parse_keys(_made_keys(spark, sf_dir)))
    return tree.fill_gaps(named).groupBy("doc_id", "tag").agg(
        F.count(F.lit(1)).alias("n_missing"), F.min("idx").alias("first_missing"), F.max("idx").alias("last_missing")
    )


@query
def tree_reconstruct(spark, sf_dir):
    """Documents rebuilt from their flat pairs."""
    return tree.rebuild(_flat(spark, sf_dir), "urn:doc").select("doc_id", "xml")


@query
def tree_reconstruct_gaps(spark, sf_dir):
    """Documents rebuilt from keys with gaps and malformed parts; documents with two roots are left out."""
    return tree.rebuild(_unique_keys(spark, sf_dir), None).select("doc_id", "xml")


@query
def tree_roundtrip(spark, sf_dir):
    """Pairs before and after flatten, rebuild, flatten; and how many differ."""
    before = staged(_flat(spark, sf_dir))
    after = tree.flatten(tree.nodes(tree.rebuild(before).select("doc_id", "xml")))
    return tree.compare(before, after).agg(
        F.sum("n_left").alias("n_pairs"), F.count_if(F.col("surplus") != 0).alias("n_different")
    )


def _order_pairs(spark, sf_dir) -> DataFrame:
    """Flat pairs of a few large documents: orders with a text and with lines that have an attribute and perhaps a text."""
    items = bridge.lines(spark, sf_dir)
    order = F.concat(F.lit("run:o"), F.col("l_orderkey"), F.lit("[0]:"))
    line = F.concat(order, F.lit("line["), F.col("l_linenumber"), F.lit("]:"))
    text = F.concat("l_returnflag", F.lit(" > & < é\n"), "l_partkey")
    pairs = F.array(
        F.struct(F.concat(order, F.lit("#text")).alias("path"), F.concat(F.lit("order "), "l_orderkey").alias("value")),
        F.struct(F.concat(line, F.lit("@part")).alias("path"), F.concat(F.lit('"'), F.col("l_partkey")).alias("value")),
        F.struct(F.concat(line, F.lit("#text")).alias("path"), F.when(F.col("l_linestatus") == "O", text).alias("value")),
    )
    doc = F.concat(F.lit("doc/"), F.col("l_orderkey") % 32)
    return items.select(doc.alias("doc_id"), F.inline(pairs)).filter(F.col("value").isNotNull())


@query
def tree_document_files(spark, sf_dir):
    """Large documents rebuilt from flat pairs into XML files by many tasks, read back and flattened."""
    path = scratch_path(spark, "documents")
    tree.write_document_files(_order_pairs(spark, sf_dir), path, compression="snappy")
    return tree.flatten(tree.nodes(tree.read_document_files(spark, path))).select("doc_id", "path", "value")


@query
def flat_json_files(spark, sf_dir):
    """The same pairs written as JSON files by many tasks, read back and taken apart."""
    path = scratch_path(spark, "json")
    tree.write_flat_json_files(_order_pairs(spark, sf_dir), path)
    return tree.from_json_objects(tree.read_document_files(spark, path, "json")).select("doc_id", "path", "value")


@query
def tree_quarantine(spark, sf_dir):
    """Documents by whether they parse: web pages do not, the made documents do."""
    pages = bridge.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page="), "page_id").alias("doc_id"), F.col("html").alias("xml")
    )
    both = bridge.xml_documents(spark, sf_dir).unionByName(pages)
    status = F.when(F.col("error").isNull(), "parsed").otherwise("quarantined")
    roots = tree.nodes(both).filter(F.col("error").isNotNull() | (F.col("depth") == 0))
    return roots.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n_docs"))


@query
def flat_json_explode(spark, sf_dir):
    pairs = tree.from_json_objects(bridge.table(spark, sf_dir, "events"), "event_id", "props")
    return pairs.select(F.col("doc_id").alias("event_id"), F.col("path").alias("key"), "value")


@query
def flat_to_json(spark, sf_dir):
    """One JSON object per user, from the event type of each of the user's events."""
    return tree.to_json_objects(_event_pairs(spark, sf_dir)).select("doc_id", "n_items", "json")


def _event_pairs(spark, sf_dir) -> DataFrame:
    return bridge.table(spark, sf_dir, "events").select(
        F.concat(F.lit("user="), "user_id").alias("doc_id"),
        F.concat(F.lit("event["), F.format_string("%010d", "event_id"), F.lit("]:@type")).alias("path"),
        F.concat("event_type", F.lit("-é")).alias("value"),
    )


# --- metadata -------------------------------------------------------------------------------------------


@query
def meta_map(spark, sf_dir):
    """Key/value rows collected to one map per user, shown whole and by a lookup."""
    events = bridge.table(spark, sf_dir, "events")
    per_type = events.groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    value = F.decode(F.encode(F.col("last").cast("string"), "UTF-8"), "UTF-8")
    maps = per_type.groupBy("user_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", value)))).alias("m")
    )
    return maps.select(
        "user_id",
        F.size("m").alias("n_keys"),
        F.try_element_at("m", F.lit("click")).alias("click"),
        F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("entries"),
    )


@query
def meta_merge(spark, sf_dir):
    """Two maps merged; where both have a key the existing entry stays."""
    events = bridge.table(spark, sf_dir, "events")
    existing = F.from_json("props", "map<string,string>")
    added = F.create_map(F.lit("k"), F.lit("new"), F.lit("type"), F.col("event_type"))
    merged = events.select("event_id", C.merge_maps(existing, added).alias("m"))
    return merged.select(
        "event_id",
        F.size("m").alias("n_keys"),
        F.try_element_at("m", F.lit("k")).alias("k"),
        F.try_element_at("m", F.lit("type")).alias("type"),
    )


@query
def run_metadata_doc(spark, sf_dir):
    """One JSON document per run, with its spectra and their precursors, read back field by field."""
    priority = F.create_map(F.lit("priority"), F.col("o_orderpriority"))
    one_precursor = F.struct(
        F.lit(None).cast("string").alias("spectrum_ref"),
        F.col("o_totalprice").alias("mz"),
        (F.col("o_custkey") % 3).cast("int").alias("charge"),
        F.lit(0.0).alias("intensity"),
        F.lit(0.5).alias("isolation_window_lower_offset"),
        F.lit(0.5).alias("isolation_window_upper_offset"),
        F.array(F.lit("dissociation method")).alias("activation_methods"),
        F.lit(0.0).alias("activation_energy"),
        priority.alias("meta_values"),
    )
    spectra = bridge.spectra(
        spark,
        sf_dir,
        extra=(
            priority.alias("meta_values"),
            F.when(F.col("o_orderstatus") != "F", F.array(one_precursor)).alias("precursors"),
            F.lit(None).cast("array<struct<mz:double>>").alias("products"),
        ),
    )
    records = metadata.spectrum_records(spectra)
    runs = bridge.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("run="), "c_custkey").alias("run_id"),
        F.struct(F.col("c_name").alias("name"), F.lit("UNKNOWN").alias("ion_optics")).alias("instrument"),
        F.array(F.struct(F.col("c_mktsegment").alias("name_of_file"))).alias("source_files"),
        F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("experiment_meta"),
    )
    events = bridge.table(spark, sf_dir, "events")
    chromatograms = events.select(
        F.concat(F.lit("run="), "user_id").alias("run_id"),
        F.col("event_id").alias("chromatogram_index"),
        F.struct(F.col("event_type").alias("native_id")).alias("record"),
    )
    documents = metadata.run_documents(runs, records, chromatograms)
    field = lambda path: F.get_json_object("document", path)
    return documents.select(
        "run_id",
        field("$.instrument.name").alias("instrument"),
        field("$.source_files[0].name_of_file").alias("file"),
        field("$.experiment_meta.nation").alias("nation"),
        F.json_array_length(field("$.spectra")).alias("n_spectra"),
        F.json_array_length(field("$.chromatograms")).alias("n_chromatograms"),
        field("$.spectra[0].native_id").alias("first_id"),
        field("$.spectra[0].meta_values.priority").alias("first_priority"),
        field("$.spectra[0].precursors[0].charge").cast("int").alias("first_charge"),
        field("$.spectra[0].precursors[0].selected_ion_charge").cast("int").alias("first_ion_charge"),
        field("$.spectra[1].precursors[0].rt").cast("double").alias("second_precursor_rt"),
        field("$.chromatograms[0].native_id").alias("first_chromatogram"),
    )


# --- mzML text ------------------------------------------------------------------------------------------


def _groups(spark, sf_dir) -> DataFrame:
    return mzml.param_groups(mzml.headers_from(bridge.header_xml(spark, sf_dir)))


def _weighted(values, scale: int):
    """A sum of scaled values times their place, which no other order of them has."""
    scaled = F.transform(values, lambda x, i: F.round(x.cast("double") * scale).cast("bigint") * (i + 1))
    return F.aggregate(scaled, F.lit(0).cast("bigint"), lambda a, x: a + x)


@query
def mzml_spectra(spark, sf_dir):
    """Spectrum elements parsed and decoded to wide rows; some levels come from the run's parameter groups."""
    elements = mzml.elements_from(bridge.spectrum_xml(spark, sf_dir), mzml.SPECTRUM_XML, groups=_groups(spark, sf_dir))
    return mzml.spectra_of(elements).select(
        "run_id", "id", "scan_index", "ms_level", *_double("rt", "ion_mobility"), "n_peaks", "mz_min", "mz_max",
        _weighted("mz_array", 100).alias("mz_weighted"), _weighted("intensity_array", 1).alias("intensity_weighted"),
    )


#: Bytes that one task reads of a run file.
RANGE_BYTES = 1 << 20


@query
def mzml_file_ranges(spark, sf_dir):
    """Run files written to the shared folder, compressed in blocks, each read by several tasks, parsed and decoded."""
    path = scratch_path(spark, "runs")
    bridge.write_run_files(spark, sf_dir, path, compression="snappy")
    files = f"{path}/*/*.txt.snappy"
    spectra = mzml.read_spectra(spark, files, groups=mzml.param_groups(mzml.read_headers(spark, files)), range_bytes=RANGE_BYTES)
    return spectra.select(
        "id", "scan_index", "ms_level", *_double("rt", "ion_mobility"), "n_peaks", "mz_min", "mz_max",
        _weighted("mz_array", 100).alias("mz_weighted"), _weighted("intensity_array", 1).alias("intensity_weighted"),
    )


@query
def mzml_spectrum_meta(spark, sf_dir):
    """Spectrum headers with every field of their precursor and product."""
    texts = bridge.spectrum_xml(spark, sf_dir, arrays=False)
    elements = mzml.elements_from(texts, mzml.SPECTRUM_XML, groups=_groups(spark, sf_dir))
    precursor, product = F.get("precursors", F.lit(0)), F.get("products", F.lit(0))
    fields = (
        "spectrum_ref", "mz", "charge", "intensity", "isolation_window_lower_offset", "isolation_window_upper_offset", "activation_energy",
    )
    return mzml.spectrum_meta_of(elements).select(
        "run_id", "id", "rt",
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries("meta_values")))).alias("meta_values"),
        *[precursor[f].alias(f"precursor_{f}") for f in fields],
        F.array_join(precursor["activation_methods"], "|").alias("activation_methods"),
        *[product[f].alias(f"product_{f}") for f in ("mz", "isolation_window_lower_offset", "isolation_window_upper_offset")],
    )


@query
def precursor_by_reference(spark, sf_dir):
    """Records of parsed spectra: a precursor's time is that of the spectrum it names, else of the last one a level below."""
    elements = mzml.elements_from(bridge.spectrum_xml(spark, sf_dir, arrays=False), mzml.SPECTRUM_XML, groups=_groups(spark, sf_dir))
    records = metadata.spectrum_records(staged(mzml.spectrum_meta_of(elements)))
    precursor, product = F.get("record.precursors", F.lit(0)), F.get("record.products", F.lit(0))
    return records.select(
        "run_id", "scan_index", "record.native_id", "record.ms_level", F.col("record.rt").cast("double").alias("rt"),
        *[
            precursor[n].cast("double").alias(f"precursor_{n}")
            for n in ("rt", "mz", "charge", "intensity", "selected_ion_mz", "selected_ion_charge", "selected_ion_intensity")
        ],
        product["mz"].alias("product_mz"),
    )


@query
def mzml_chromatograms(spark, sf_dir):
    elements = mzml.elements_from(bridge.chromatogram_xml(spark, sf_dir), mzml.CHROMATOGRAM_XML)
    return mzml.chromatograms_of(elements).select(
        "run_id", "id", "chromatogram_index", "data_type", *_double("precursor_mz", "product_mz"), F.size("time_array").alias("n_points"),
        _weighted("time_array", 1_000_000).alias("time_weighted"),
        F.element_at("intensity_array", 1).cast("double").alias("intensity_first"),
        F.element_at("intensity_array", -1).cast("double").alias("intensity_last"),
    )


@query
def mzml_chromatogram_meta(spark, sf_dir):
    elements = mzml.elements_from(bridge.chromatogram_xml(spark, sf_dir), mzml.CHROMATOGRAM_XML)
    records = metadata.chromatogram_records(mzml.chromatogram_meta_of(elements))
    return records.select(
        "run_id", "chromatogram_index", "record.native_id", F.array_join(F.map_keys("record.meta_values"), "|").alias("terms"),
        F.col("record.precursor.mz").alias("precursor_mz"), F.col("record.product.mz").alias("product_mz"),
    )


@query
def mzml_headers(spark, sf_dir):
    """Run headers to instrument, software, components, source files and run parameters."""
    runs = metadata.run_records(mzml.headers_from(bridge.header_xml(spark, sf_dir)))
    i, f = F.col("instrument"), F.get("source_files", F.lit(0))
    source, analyzer, detector = (F.get(i[n], F.lit(0)) for n in ("ion_sources", "mass_analyzers", "ion_detectors"))
    return runs.select(
        "run_id", i["name"].alias("instrument"), i["customizations"].alias("customizations"), i["ion_optics"].alias("ion_optics"),
        i["software"]["name"].alias("software"), i["software"]["version"].alias("version"),
        source["order"].alias("source_order"), source["polarity"].alias("polarity"),
        source["ionization_method"].alias("ionization_method"), source["inlet_type"].alias("inlet_type"),
        F.size(i["mass_analyzers"]).alias("n_analyzers"),
        F.array_join(i["mass_analyzers"]["type"], "|").alias("analyzers"), analyzer["resolution"].alias("resolution"),
        analyzer["scan_law"].alias("scan_law"), detector["type"].alias("detector"),
        detector["adc_sampling_frequency"].alias("sampling"), detector["acquisition_mode"].alias("acquisition_mode"),
        *[f[n].alias(n) for n in (
            "name_of_file", "path_to_file", "file_type", "checksum", "checksum_type", "native_id_type", "native_id_type_accession",
        )],
        F.to_json("experiment_meta").alias("experiment_meta"),
    )


@query
def mzml_quarantine(spark, sf_dir):
    """Spectrum elements cut short, by run: they are named, not read as empty spectra."""
    texts = bridge.spectrum_xml(spark, sf_dir, arrays=False)
    broken = F.col("scan_index") % 10 == 0
    cut = texts.withColumn("xml", F.when(broken, F.expr("substring(xml, 1, length(xml) - 5)")).otherwise(F.col("xml")))
    elements = mzml.elements_from(cut, mzml.SPECTRUM_XML)
    bad = mzml.quarantine(elements).groupBy("run_id", "error").agg(F.count(F.lit(1)).alias("n_broken"))
    good = mzml.spectrum_meta_of(elements).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_read"))
    return bad.join(good, "run_id", "left").select("run_id", "error", "n_broken", F.coalesce("n_read", F.lit(0)).cast("bigint").alias("n_read"))


@query
def json_quarantine(spark, sf_dir):
    """Flat JSON documents, some cut short: those that are no object."""
    objects = tree.to_json_objects(_event_pairs(spark, sf_dir))
    cut = F.substring(F.col("doc_id"), 6, 20).cast("bigint") % 3 == 0
    docs = objects.select("doc_id", F.when(cut, F.expr("substring(json, 1, length(json) - 1)")).otherwise(F.col("json")).alias("json"))
    return tree.json_quarantine(docs)


@query
def metadata_attached(spark, sf_dir):
    """Both layouts of parsed runs written with the runs' documents, which are made of parsed headers, spectra and chromatograms;
    all read back together. Records are shown by sums over the whole document, weighted by place."""
    path = scratch_path(spark, "attached")
    headers = mzml.headers_from(bridge.header_xml(spark, sf_dir))
    spectra = mzml.elements_from(staged(bridge.spectrum_xml(spark, sf_dir)), mzml.SPECTRUM_XML, groups=mzml.param_groups(headers))
    texts = bridge.chromatogram_xml(spark, sf_dir).withColumn("run_id", F.replace("run_id", F.lit("user="), F.lit("run=")))
    chromatograms = mzml.elements_from(staged(texts), mzml.CHROMATOGRAM_XML)
    documents = staged(metadata.documents_of(headers, staged(mzml.spectrum_meta_of(spectra)), mzml.chromatogram_meta_of(chromatograms)))
    wide, traces = staged(mzml.spectra_of(spectra)), staged(mzml.chromatograms_of(chromatograms))
    tables.write_wide(wide, traces, f"{path}-wide", documents=documents)
    tables.write_long(layout.long_table(wide, traces), f"{path}-long", documents=documents)
    of_kind = lambda kind, name: F.count_if(F.col("data_type") == kind).alias(name)
    peaks = tables.read_long(spark, f"{path}-long").groupBy("run_id").agg(of_kind(layout.SPECTRUM, "n_peaks"), of_kind(layout.CHROMATOGRAM, "n_points"))
    headers_read = tables.read_wide(spark, f"{path}-wide")[0].groupBy("run_id").agg(F.count(F.lit(1)).alias("n_wide"))
    beside_wide = tables.read_documents(spark, f"{path}-wide").select("run_id", F.col("document").alias("other"))
    whole = tables.read_documents(spark, f"{path}-long").join(beside_wide, "run_id", "full").withColumn("d", F.from_json("document", DOCUMENT))
    none = F.lit(0.0)
    by_place = lambda value: _weighted(F.transform("d.spectra", lambda x: F.coalesce(value(x), none)), 1000)
    in_first = lambda child, name: lambda x: F.get(x[child], F.lit(0))[name]
    return whole.join(peaks, "run_id", "left").join(headers_read, "run_id", "left").select(
        "run_id", F.col("d.instrument.name").alias("instrument"), F.get("d.source_files", F.lit(0))["checksum"].alias("checksum"),
        F.size("d.spectra").alias("n_spectra"), F.size("d.chromatograms").alias("n_chromatograms"),
        by_place(lambda x: F.substring(x["native_id"], 6, 20).cast("double")).alias("ids"),
        by_place(lambda x: x["rt"]).alias("times"),
        by_place(in_first("precursors", "rt")).alias("precursor_times"),
        by_place(in_first("precursors", "selected_ion_charge")).alias("precursor_charges"),
        by_place(in_first("products", "mz")).alias("product_mzs"),
        F.get("d.chromatograms", F.lit(0))["precursor"]["mz"].alias("precursor_mz"),
        F.col("document").eqNullSafe(F.col("other")).alias("same"),
        *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("n_peaks", "n_points", "n_wide")],
    )


#: What of a document the query above reads.
DOCUMENT = (
    "instrument struct<name:string>, source_files array<struct<checksum:string>>, "
    "spectra array<struct<native_id:string,rt:double,precursors:array<struct<rt:double,selected_ion_charge:double>>,products:array<struct<mz:double>>>>, "
    "chromatograms array<struct<precursor:struct<mz:double>>>"
)
