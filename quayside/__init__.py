"""Spark-native analytics over the metadata and telemetry of a tiered, replicated storage fleet."""

import sys

from pyspark import cloudpickle

# Functions that run on executors carry the package's code with them, so it needs to be installed on the driver alone.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
