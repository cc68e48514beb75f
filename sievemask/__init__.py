"""Find, mask, restore, score and audit personal data in text tables with Spark."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with their task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
