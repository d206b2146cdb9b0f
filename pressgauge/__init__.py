"""News-attention analytics as PySpark jobs over a bronze / silver / gold lake."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with their job, so that executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
