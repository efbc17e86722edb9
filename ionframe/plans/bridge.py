"""The driver's generated tables seen as mass-spectrometry data.

orders are spectrum headers, lineitem rows their peaks, events the points of chromatograms. A run is a
customer. Range arguments narrow a view before it is built, on the stored columns, so that they reach the
Parquet scan; they are slightly wider than the float test that follows, never tighter.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionframe.functions import codec
from ionframe.functions import columns as C
from ionframe.operators import grouping, layout

DAY_ZERO = "1995-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows whose XML text one task makes and parses: fractions of a millisecond for each spectrum, more for a run header; and rows of
#: lineitem whose flat keys it makes and parses.
SPECTRA_PER_TASK, HEADERS_PER_TASK, LINES_PER_TASK = 20_000, 4_000, 200_000


def _tasks(table: DataFrame, rows_per_task: int) -> int:
    """How many tasks the rows of a stored table make work for. Their stored bytes say little about it: a few megabytes of rows,
    which Spark reads or merges in one task, become many minutes of text. The count comes from the files' footers."""
    return max(1, -(-table.count() // rows_per_task))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem, spread over as many tasks as there is work for."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    return items.repartition(_tasks(items, LINES_PER_TASK))


def spectra(
    spark: SparkSession,
    sf_dir: str,
    rt: tuple[float, float] | None = None,
    ms_levels: tuple[int, ...] = (1, 2, 3),
    extra: tuple[Column, ...] = (),
) -> DataFrame:
    """Spectrum headers: ``run_id, scan_index, id, ms_level, rt, ion_mobility``, and ``extra`` columns of orders."""
    orders = table(spark, sf_dir, "orders")
    if rt:
        # The bounds take the column's own type (with or without time zone), or they would not be pushed down.
        stored = orders.schema["o_orderdate"].dataType
        day = lambda d: F.date_add(F.lit(DAY_ZERO).cast("date"), int(d)).cast(stored)
        orders = orders.filter(F.col("o_orderdate").between(day(rt[0] - 1), day(rt[1] + 2)))
    if len(ms_levels) < 3:
        orders = orders.filter(F.col("o_orderstatus").isin(["FOP"[k - 1] for k in ms_levels]))
    status = F.col("o_orderstatus")
    return orders.select(
        F.concat(F.lit("run="), F.col("o_custkey")).alias("run_id"),
        F.col("o_orderkey").alias("scan_index"),
        F.concat(F.lit("scan="), F.col("o_orderkey")).alias("id"),
        F.when(status == "F", 1).when(status == "O", 2).when(status == "P", 3).cast("byte").alias("ms_level"),
        F.datediff(F.col("o_orderdate"), F.lit(DAY_ZERO).cast("date")).cast("float").alias("rt"),
        C.null_if_zero((F.col("o_orderkey") % 8) * F.lit(0.25)).cast("float").alias("ion_mobility"),
        *extra,
    )


def peaks(spark: SparkSession, sf_dir: str, mz: tuple[float, float] | None = None) -> DataFrame:
    """Peak rows, unjoined: ``scan_index``, the order within the spectrum, ``mz`` and ``intensity`` as stored."""
    items = table(spark, sf_dir, "lineitem")
    if mz:
        items = items.filter(F.col("l_extendedprice").between(mz[0] - 1, mz[1] + 1))
    return items.select(
        F.col("l_orderkey").alias("scan_index"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_extendedprice").alias("mz"),
        F.col("l_quantity").alias("intensity"),
    )


PEAK_ORDER = ("line", "part", "supp")


def spectrum_peaks(
    spark: SparkSession,
    sf_dir: str,
    mz: tuple[float, float] | None = None,
    rt: tuple[float, float] | None = None,
    ms_levels: tuple[int, ...] = (1, 2, 3),
) -> DataFrame:
    """Spectrum rows of the long layout (float32 measures), in no particular order within a spectrum."""
    rows = spectra(spark, sf_dir, rt, ms_levels).join(peaks(spark, sf_dir, mz), "scan_index")
    return rows.select(
        "run_id",
        "id",
        F.lit(layout.SPECTRUM).alias("data_type"),
        "ms_level",
        "rt",
        F.col("mz").cast("float").alias("mz"),
        F.col("intensity").cast("float").alias("intensity"),
        "ion_mobility",
    )


def wide_spectra(spark: SparkSession, sf_dir: str, mz_type: str = "double", **header) -> DataFrame:
    """Wide spectra; those without peaks have empty arrays."""
    return layout.assemble_spectra(
        spectra(spark, sf_dir, **header),
        peaks(spark, sf_dir),
        "scan_index",
        PEAK_ORDER,
        mz_type=mz_type,
    )


def chromatogram_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.select(
        F.concat(F.lit("user="), F.col("user_id")).alias("run_id"),
        F.concat("event_type", F.lit("_"), F.col("user_id")).alias("id"),
        (F.col("user_id") + 0.25).cast("float").alias("precursor_mz"),
        (F.col("user_id") + 0.5).cast("float").alias("product_mz"),
        F.col("event_id"),
        F.unix_micros("ts").alias("micros"),
        ((F.unix_micros("ts") - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / F.lit(1e6)).alias("time"),
        F.col("value").alias("intensity"),
    )


POINT_ORDER = ("micros", "event_id")


def wide_chromatograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide chromatograms, one per (event type, user)."""
    return layout.pack_chromatograms(chromatogram_points(spark, sf_dir), order=POINT_ORDER)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def xml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One XML document per spectrum: header attributes, a blank text, and its peaks under two child tags.

    The child order mixes the tags, and peaks carry text with characters to escape.
    """
    qty, flag = F.col("l_quantity").cast("int"), F.col("l_returnflag")
    child = F.concat(
        F.lit("<"), flag, F.lit(' supp="'), "l_suppkey", F.lit('" part="'), "l_partkey", F.lit('"> '),
        F.when(F.col("l_linestatus") == "O", F.concat(qty, F.lit(" &lt; &amp; "), "l_linenumber")).otherwise(F.lit("")),
        F.lit(" </"), flag, F.lit(">"),
    )
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scan_index"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        qty.alias("qty"),
        flag.alias("flag"),
        F.col("l_linestatus").alias("status"),
        child.alias("child"),
    )
    heads = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("scan_index"), "o_orderpriority", "o_orderstatus"
    )
    packed = grouping.pack_under(heads, items, ("scan_index",), PEAK_ORDER, ("qty", "flag", "status", "child"))
    xml = F.concat(
        F.lit('<run xmlns="urn:doc" status="'), F.col("o_orderstatus"), F.lit('" prio="'), F.col("o_orderpriority"),
        F.lit('">\n'), F.lit("<note>&quot;"), F.col("o_orderpriority"), F.lit("&quot;</note>"),
        F.array_join("items.child", "\n"), F.lit("</run>"),
    )
    return packed.select(F.col("scan_index").cast("string").alias("doc_id"), xml.alias("xml"))


# --- the same tables as mzML text ------------------------------------------------------------------------


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _cv(accession, name, value="", unit: Column | str | None = None) -> Column:
    text = _text('<cvParam accession="', accession, '" name="', name, '" value="', value, '"')
    return _text(text, ' unitAccession="', unit, '"/>') if unit is not None else _text(text, "/>")


def _window(mz: Column, lower, upper) -> Column:
    return _text(
        "<isolationWindow>", _cv("MS:1000827", "isolation window target m/z", mz), _cv("MS:1000828", "lower", lower),
        _cv("MS:1000829", "upper", upper), "</isolationWindow>",
    )


def _binary(values: Column, role: str, name: str, bits: Column, zipped: Column) -> Column:
    return _text(
        "<binaryDataArray>",
        F.when(bits == 64, _cv("MS:1000523", "64-bit float")).otherwise(_cv("MS:1000521", "32-bit float")),
        F.when(zipped, _cv("MS:1000574", "zlib compression")).otherwise(_cv("MS:1000576", "no compression")),
        _cv(role, name), "<binary>", codec.encode_array(values, bits, zipped), "</binary></binaryDataArray>",
    )


def spectrum_xml(spark: SparkSession, sf_dir: str, arrays: bool = True) -> DataFrame:
    """One spectrum element per order as ``(run_id, scan_index, xml)``. Levels above 1 have a precursor, level 3 a product;
    the level of every fifth spectrum is in a parameter group; odd ones give their time in minutes."""
    heads = _spectrum_heads(spark, sf_dir)
    tasks = _tasks(table(spark, sf_dir, "orders"), SPECTRA_PER_TASK)
    if arrays:
        heads = grouping.pack_under(heads, peaks(spark, sf_dir), ("scan_index",), PEAK_ORDER, ("mz", "intensity"), tasks=tasks)
    else:
        heads = heads.repartition(tasks)
    return heads.select("run_id", "scan_index", _spectrum_text(arrays).alias("xml"))


def _spectrum_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra(spark, sf_dir, extra=(F.col("o_custkey"), F.col("o_orderpriority")))


def _spectrum_text(arrays: bool) -> Column:
    """The element of a spectrum's header, with its packed peaks if it has ``arrays``."""
    key, cust = F.col("scan_index"), F.col("o_custkey")
    if arrays:
        bits, zipped = F.when(key % 2 == 0, 64).otherwise(32), key % 3 != 0
        lists = _text(
            "<binaryDataArrayList>", _binary(F.col("items.mz"), "MS:1000514", "m/z array", F.lit(64), zipped),
            _binary(F.col("items.intensity"), "MS:1000515", "intensity array", bits, zipped), "</binaryDataArrayList>",
        )
        length = F.size("items")
    else:
        lists, length = F.lit(""), F.lit(0)
    level = F.when(key % 5 == 0, _text('<referenceableParamGroupRef ref="level', F.col("ms_level"), '"/>')).otherwise(
        _cv("MS:1000511", "ms level", F.col("ms_level"))
    )
    unit = F.when(key % 2 == 1, "UO:0000031").otherwise("UO:0000010")
    scan = _text(
        "<scanList><scan>", _cv("MS:1000016", "scan start time", F.col("rt").cast("int"), unit),
        _cv("MS:1002476", "ion mobility drift time", (key % 8) * F.lit(0.25)), '<userParam name="preset" value="p', key % 4,
        '"/></scan></scanList>',
    )
    precursor = _text(
        "<precursorList><precursor", F.when(key % 7 == 0, _text(' spectrumRef="scan=', key - 1, '"')).otherwise(""), ">",
        _window(cust + 0.25, "0.5", "0.75"), "<selectedIonList><selectedIon>",
        F.when(key % 11 != 0, _cv("MS:1000744", "selected ion m/z", cust + 0.5)).otherwise(""),
        _cv("MS:1000041", "charge state", cust % 3), _cv("MS:1000042", "peak intensity", key % 100),
        "</selectedIon></selectedIonList><activation>", _cv("MS:1000133", "collision-induced dissociation"),
        _cv("MS:1000045", "collision energy", cust % 40), "</activation></precursor></precursorList>",
    )
    product = _text("<productList><product>", _window(cust + 0.125, "1", "2"), "</product></productList>")
    return _text(
        '<spectrum index="', key, '" id="', F.col("id"), '" defaultArrayLength="', length, '">', level,
        _cv("MS:1000000", "priority", F.col("o_orderpriority")), scan,
        F.when(F.col("ms_level") > 1, precursor).otherwise(""), F.when(F.col("ms_level") == 3, product).otherwise(""),
        lists, "</spectrum>",
    )


def chromatogram_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chromatogram element per (event type, user) as ``(run_id, xml)``; those of users divisible by 3 have no product."""
    points = chromatogram_points(spark, sf_dir).withColumn("user_id", F.substring("run_id", 6, 20).cast("bigint"))
    packed = grouping.pack(points, ("run_id", "id", "user_id"), POINT_ORDER, ("time", "intensity"))
    user = F.col("user_id")
    product = F.when(user % 3 != 0, _text("<product>", _window(user + 0.5, "0", "0"), "</product>")).otherwise("")
    xml = _text(
        '<chromatogram index="', user, '" id="', F.col("id"), '" defaultArrayLength="', F.size("items"), '">',
        _cv("MS:1000235", "total ion current chromatogram"), "<precursor>", _window(user + 0.25, "0", "0"), "</precursor>",
        product, "<binaryDataArrayList>",
        _binary(F.col("items.time"), "MS:1000595", "time array", F.lit(64), F.lit(True)),
        _binary(F.col("items.intensity"), "MS:1000515", "intensity array", F.lit(32), F.lit(True)),
        "</binaryDataArrayList></chromatogram>",
    )
    return packed.select("run_id", xml.alias("xml"))


def header_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run header per customer as ``(run_id, xml)``: two instrument configurations, the instrument's model in a
    parameter group, the terms chosen by the customer's key."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    even = key % 2 == 0
    groups = _text(
        "<referenceableParamGroupList>", *[
            _text(f'<referenceableParamGroup id="level{k}">', _cv("MS:1000511", "ms level", str(k)), "</referenceableParamGroup>")
            for k in (1, 2, 3)
        ],
        '<referenceableParamGroup id="model">', _cv("MS:1001911", _text("Model ", nation)),
        "</referenceableParamGroup></referenceableParamGroupList>",
    )
    files = _text(
        "<fileDescription><fileContent/><sourceFileList>",
        _text('<sourceFile id="F1" name="', F.col("c_name"), '.raw" location="file:///', F.col("c_mktsegment"), '">'),
        _cv("MS:1000768", "Thermo nativeID format"), _cv("MS:1000563", "Thermo RAW format"),
        F.when(even, _cv("MS:1000569", "SHA-1", key)).otherwise(_cv("MS:1000568", "MD5", key)),
        "</sourceFile></sourceFileList></fileDescription>",
    )
    software = _text(
        '<softwareList><software id="S1" version="', nation, '.1">', _cv("MS:1000532", "Xcalibur"),
        '</software><software id="S2" version="9">', _cv("MS:1000615", "other"), "</software></softwareList>",
    )
    parts = _text(
        '<componentList><source order="1">',
        F.when(even, _cv("MS:1000073", "electrospray ionization")).otherwise(_cv("MS:1000075", "maldi")),
        F.when(key % 3 == 0, _cv("MS:1000130", "positive scan")).otherwise(""), _cv("MS:1000485", "nanospray inlet"),
        '</source><analyzer order="2">',
        F.when(even, _cv("MS:1000484", "orbitrap")).otherwise(_cv("MS:1000084", "time-of-flight")),
        _cv("MS:1000011", "mass resolution", nation * 1000), "</analyzer>",
        F.when(key % 4 == 0, _text('<analyzer order="3">', _cv("MS:1000081", "quadrupole"), "</analyzer>")).otherwise(""),
        '<detector order="4">', _cv("MS:1000624", "inductive detector"), _cv("MS:1000029", "sampling frequency", nation),
        "</detector></componentList>",
    )
    configurations = _text(
        '<instrumentConfigurationList><instrumentConfiguration id="IC0"/><instrumentConfiguration id="IC1">',
        '<referenceableParamGroupRef ref="model"/>', F.when(even, _cv("MS:1000032", "customization", "none")).otherwise(""),
        parts, '<softwareRef ref="S1"/></instrumentConfiguration></instrumentConfigurationList>',
    )
    xml = _text(
        "<mzML>", files, groups, software, configurations,
        '<run id="r" defaultInstrumentConfigurationRef="IC1"><userParam name="segment" value="', F.col("c_mktsegment"), '"/></run></mzML>',
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    spread = customers.repartition(_tasks(customers, HEADERS_PER_TASK))
    return spread.select(_text("run=", key).alias("run_id"), xml.alias("xml"))


#: Files that the spectra are written to, at least, and spectra in a file, at most about: a file is written by one task.
RUN_FILES, SPECTRA_PER_FILE = 8, 100_000


def write_run_files(spark: SparkSession, sf_dir: str, path: str, compression: str = "none") -> None:
    """The spectrum elements as mzML files, several runs in each, with comments, CDATA and instructions that hold other elements.
    Headers and peaks are brought to the task that writes their file, and only there made into text."""
    files = max(RUN_FILES, _tasks(table(spark, sf_dir, "orders"), SPECTRA_PER_FILE))
    file = F.pmod(F.xxhash64(F.col("scan_index").cast("long")), F.lit(files)).cast("int").alias("file")
    groups = "".join(
        f'<referenceableParamGroup id="level{n}"><cvParam accession="MS:1000511" name="ms level" value="{n}"/></referenceableParamGroup>'
        for n in (1, 2, 3)
    )
    head = (
        '<?xml version="1.0" encoding="utf-8"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><referenceableParamGroupList>'
        f'{groups}</referenceableParamGroupList><run id="r"><spectrumList count="0">'
    )
    # What comes before and after the spectra of a file has no key, and its place there is 0 and 2.
    ends = spark.range(files).select(
        F.col("id").cast("int").alias("file"),
        F.inline(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(v).alias("end")) for k, v in ((0, head), (2, "</spectrumList></run></mzML>"))])),
    )
    body, keys = F.lit(1).alias("place"), ("file", "place", "scan_index")
    packed = grouping.pack_under(
        _spectrum_heads(spark, sf_dir).select("*", file, body).unionByName(ends, allowMissingColumns=True),
        peaks(spark, sf_dir).select("*", file, body), keys, PEAK_ORDER, ("mz", "intensity"), tasks=files, by=("file",),
    )
    noise = F.when(F.col("scan_index") % 10 == 0, '<!-- <spectrum id="no"> -->').when(
        F.col("scan_index") % 10 == 1, '<userParam name="x"><![CDATA[<spectrum id="no">]]></userParam><?note <spectrum?>'
    )
    value = F.coalesce("end", F.concat(F.coalesce(noise, F.lit("")), _spectrum_text(arrays=True)))
    lines = packed.select(*keys, value.alias("value")).sortWithinPartitions(*keys)
    lines.select("file", "value").write.partitionBy("file").option("compression", compression).text(path)
