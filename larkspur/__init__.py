"""larkspur: retrieval, evidence and corpus analytics on PySpark.

Functions take and return DataFrames or Columns, so Catalyst plans the work.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: a cluster then needs
# no copy of this package on its executors' path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
