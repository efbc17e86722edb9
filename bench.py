"""Headline queries and the storage life cycle of the long layout, timed. Prints one JSON line."""

import contextlib
import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from ionframe.operators import extract, layout, metadata  # noqa: E402
from ionframe.plans import bridge  # noqa: E402
from ionframe.plans.queries import QUERIES, _long_table, boxes  # noqa: E402
from ionframe.session import scratch_path, staged  # noqa: E402
from ionframe.sources import mzml, tables  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "extract_box extract_box_wide wide_has_mz extract_boxes_batch box_mean_hits fetch_by_ids fetch_sampled count_spectra "
    "wide_to_long long_to_wide chrom_wide long_union precursor_asof scan_index array_codec_roundtrip "
    "tree_flatten tree_reconstruct run_metadata_doc"
).split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("ionframe-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(f) -> float:
    start = time.perf_counter()
    f()
    return round(time.perf_counter() - start, 4)


def main() -> None:
    spark = session()
    run(bridge.spectrum_peaks(spark, SF_DIR))  # start the JVM's compilers and the file cache
    seconds = {}
    for name in HEADLINE:
        query = QUERIES[name]
        run(query(spark, SF_DIR))
        seconds[name] = timed(lambda: run(query(spark, SF_DIR)))

    # The life cycle the published baseline times: write, read whole, open, fetch 100 ids, boxes one by one.
    path = scratch_path(spark, "long")
    seconds["store_write_long_plain"] = timed(
        lambda: tables.write_long(_long_table(spark, SF_DIR), path + "-plain", clustered=False)
    )
    seconds["store_write_long_clustered"] = timed(lambda: tables.write_long(_long_table(spark, SF_DIR), path))
    seconds["store_read_long"] = timed(lambda: run(tables.read_long(spark, path)))
    seconds["store_open_long"] = timed(lambda: tables.read_long(spark, path).schema)
    long = tables.read_long(spark, path)
    ids = [(r.run_id, r.id) for r in extract.sample_ids(layout.distinct_ids(long), 100).collect()]
    seconds["store_fetch_100_ids"] = timed(lambda: run(extract.fetch_by_ids(long, ids)))
    seconds["store_fetch_per_id"] = round(seconds["store_fetch_100_ids"] / 100, 6)
    for level in (1, 2):
        some = [b for b in boxes() if b[1] == level][:20]
        total = timed(lambda: [run(extract.extract_box(long, b[2], b[3], b[4], b[5], level)) for b in some])
        seconds[f"store_box_ms{level}"] = round(total / len(some), 4)
    seconds["store_boxes_batch_100"] = timed(
        lambda: run(extract.extract_boxes(long, extract.box_table(spark, boxes())))
    )

    # Parsing: spectrum elements decoded to wide rows, run headers, and the documents made of both.
    texts, heads = staged(bridge.spectrum_xml(spark, SF_DIR)), staged(bridge.header_xml(spark, SF_DIR))
    headers = mzml.headers_from(heads)
    elements = mzml.elements_from(texts, mzml.SPECTRUM_XML, groups=mzml.param_groups(headers))
    seconds["ingest_spectra"] = timed(lambda: run(mzml.spectra_of(elements)))
    seconds["ingest_headers"] = timed(lambda: run(metadata.run_records(headers)))
    chromatograms = mzml.chromatogram_meta_of(mzml.elements_from(bridge.chromatogram_xml(spark, SF_DIR), mzml.CHROMATOGRAM_XML))
    seconds["metadata_documents"] = timed(
        lambda: run(metadata.documents_of(headers, staged(mzml.spectrum_meta_of(elements)), staged(chromatograms)))
    )

    total = round(sum(seconds[n] for n in HEADLINE), 3)
    print(json.dumps({
        "metric": "headline query seconds", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    with contextlib.suppress(KeyboardInterrupt):
        main()
