"""The long layout (one row per peak), the wide layout (array rows), and the ways between them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionframe import schemas
from ionframe.operators import grouping

SPECTRUM, CHROMATOGRAM = "spectrum", "chromatogram"
SPECTRUM_KEYS = ("run_id", "id", "ms_level", "rt", "ion_mobility")
CHROMATOGRAM_KEYS = ("run_id", "id", "precursor_mz", "product_mz")


def explode_pair(df: DataFrame, first: str, second: str, first_out: str, second_out: str) -> DataFrame:
    """One row per element of two parallel arrays, up to the shorter one; the other columns are repeated.

    ``arrays_zip`` pads the shorter array with nulls. The padded tail is dropped by position after the
    generator, which keeps the arrays uncopied.
    """
    rest = [c for c in df.columns if c not in (first, second)]
    shorter = F.least(F.size(first), F.size(second))
    return (
        df.select(*rest, shorter.alias("_len"), F.posexplode(F.arrays_zip(first, second)).alias("peak_index", "_p"))
        .filter(F.col("peak_index") < F.col("_len"))
        .select(
            *rest,
            "peak_index",
            F.col("_p").getField(first).alias(first_out),
            F.col("_p").getField(second).alias(second_out),
        )
    )


def spectra_to_long(wide: DataFrame) -> DataFrame:
    """Wide spectra to peak rows. Spectra without peaks give no rows."""
    header = wide.select(*SPECTRUM_KEYS, "mz_array", "intensity_array")
    peaks = explode_pair(header, "mz_array", "intensity_array", "mz", "intensity")
    return schemas.conform(peaks.withColumn("data_type", F.lit(SPECTRUM)), schemas.LONG)


def chromatograms_to_long(wide: DataFrame, missing_product_mz: float | None = None) -> DataFrame:
    """Wide chromatograms to point rows: the point's time becomes ``rt``, the product's m/z becomes ``mz``.

    A chromatogram without a product has null ``mz``, or ``missing_product_mz`` where that is given.
    """
    header = wide.select("run_id", "id", "product_mz", "time_array", "intensity_array")
    points = explode_pair(header, "time_array", "intensity_array", "rt", "intensity")
    mz = F.coalesce(F.col("product_mz"), F.lit(missing_product_mz).cast("float"))
    points = points.withColumn("mz", mz).withColumn("data_type", F.lit(CHROMATOGRAM))
    return schemas.conform(points, schemas.LONG)


def long_table(spectra: DataFrame, chromatograms: DataFrame) -> DataFrame:
    """Both kinds of rows in one table, told apart by ``data_type``."""
    return spectra_to_long(spectra).unionByName(chromatograms_to_long(chromatograms))


def pack_spectra(
    peaks: DataFrame, keys: tuple = SPECTRUM_KEYS, order: tuple = ("peak_index",), mz_type: str = "double"
) -> DataFrame:
    """Peak rows to wide spectrum rows, with ``n_peaks``, ``mz_min`` and ``mz_max`` kept beside the arrays.

    The range columns are what lets a reader skip spectra: predicates on array elements never reach Parquet.
    """
    return _arrays(grouping.pack(peaks, keys, order, ("mz", "intensity")), mz_type)


def assemble_spectra(
    headers: DataFrame, peaks: DataFrame, key: str, order: tuple, mz_type: str = "double"
) -> DataFrame:
    """Wide spectrum rows from a header table and a peak table that share ``key``.

    A spectrum without peaks keeps its row, with empty arrays.
    """
    return _arrays(grouping.pack_under(headers, peaks, (key,), order, ("mz", "intensity")), mz_type)


def _arrays(packed: DataFrame, mz_type: str) -> DataFrame:
    return with_mz_range(
        packed.withColumns({
            "data_type": F.lit(SPECTRUM),
            "mz_array": F.col("items.mz").cast(f"array<{mz_type}>"),
            "intensity_array": F.col("items.intensity").cast("array<float>"),
        }).drop("items")
    )


def with_mz_range(wide: DataFrame) -> DataFrame:
    return wide.withColumns({
        "n_peaks": F.least(*[F.coalesce(F.size(c), F.lit(0)) for c in ("mz_array", "intensity_array")]),
        "mz_min": F.array_min("mz_array"),
        "mz_max": F.array_max("mz_array"),
    })


def pack_chromatograms(
    points: DataFrame, keys: tuple = CHROMATOGRAM_KEYS, order: tuple = ("peak_index",)
) -> DataFrame:
    """Point rows (``time``, ``intensity``) to wide chromatogram rows."""
    return grouping.pack(points, keys, order, ("time", "intensity")).select(
        *keys,
        F.lit(CHROMATOGRAM).alias("data_type"),
        F.col("items.time").cast("array<double>").alias("time_array"),
        F.col("items.intensity").cast("array<float>").alias("intensity_array"),
    )


def distinct_ids(long: DataFrame) -> DataFrame:
    """The spectra in a long table as ``(run_id, id)``; native ids start anew in every run."""
    return long.filter(F.col("data_type") == SPECTRUM).select("run_id", "id").distinct()


def narrow(df: DataFrame, types: dict[str, str], strict: bool = True) -> DataFrame:
    """Narrowing casts. Strict raises on overflow (ANSI); lenient turns what does not fit into null."""
    return df.withColumns({
        c: F.col(c).cast(t) if strict else F.col(c).try_cast(t) for c, t in types.items()
    })

