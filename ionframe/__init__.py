"""Mass-spectrometry runs as Spark DataFrames: ingest, layouts, peak extraction, metadata, XML trees."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
