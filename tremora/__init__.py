"""Network-stress analytics over panels of asset time series, built on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so workers need neither the package on
# their path nor --py-files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
