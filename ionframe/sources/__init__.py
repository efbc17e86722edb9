"""Readers and writers: mzML, XML text, Parquet layouts, JSON."""
