"""Reliability-growth analytics over many series, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions sent to them are pickled whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
