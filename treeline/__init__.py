"""File-inventory analytics on Spark DataFrames.

One row per file and directory; duplicates, inherited decisions, batch scoring,
content preparation, copy and delete plans are DataFrame operations.
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so a cluster
# needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
