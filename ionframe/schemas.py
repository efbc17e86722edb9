"""Explicit table schemas. Nothing is inferred, so empty inputs give empty tables, not errors."""

from pyspark.sql import types as T

LONG = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("ms_level", T.ByteType()),
    T.StructField("rt", T.FloatType()),
    T.StructField("mz", T.FloatType()),
    T.StructField("intensity", T.FloatType()),
    T.StructField("ion_mobility", T.FloatType()),
    T.StructField("peak_index", T.IntegerType()),
])

# Where a spectrum lies in the long layout.
INDEX = T.StructType([LONG[name] for name in ("run_id", "id", "ms_level", "rt")])

WIDE_SPECTRA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("ms_level", T.ByteType()),
    T.StructField("rt", T.FloatType()),
    T.StructField("ion_mobility", T.FloatType()),
    T.StructField("mz_array", T.ArrayType(T.DoubleType())),
    T.StructField("intensity_array", T.ArrayType(T.FloatType())),
    T.StructField("n_peaks", T.IntegerType()),
    T.StructField("mz_min", T.DoubleType()),
    T.StructField("mz_max", T.DoubleType()),
])

WIDE_CHROMATOGRAMS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("precursor_mz", T.FloatType()),
    T.StructField("product_mz", T.FloatType()),
    T.StructField("time_array", T.ArrayType(T.DoubleType())),
    T.StructField("intensity_array", T.ArrayType(T.FloatType())),
])

# One row per element of an XML document; a document that does not parse gives one row with ``error`` set.
TREE_NODES = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("node_id", T.LongType()),
    T.StructField("parent_id", T.LongType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("attrs", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("value", T.StringType()),
    ]))),
    T.StructField("text", T.StringType()),
    T.StructField("error", T.StringType()),
])


def conform(df, schema):
    """Select ``schema``'s columns from ``df`` in order, cast; columns ``df`` lacks become typed nulls."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])
