"""Code-property graphs as DataFrames: nodes, edges and call claims, and operators on them.

Functions that run on executors are shipped by value: workers need no copy of
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
