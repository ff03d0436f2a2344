"""Time-series consolidation, look-back features, data-quality reports and
learning jobs over wearable-style tables, expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
