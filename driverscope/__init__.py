"""Feature, evaluation and reporting jobs for multi-rate driving recordings, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python steps travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
