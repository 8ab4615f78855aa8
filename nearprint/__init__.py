"""nearprint: exact article similarity and recommendation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions run in Python workers travel with the plan, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
