"""Operators of a training-data pipeline over tables of documents.

Each module holds one operator with its own interface; ``registry`` registers
the queries ``op1_`` to ``op13_`` on it and their SQL, where SQL can say it.
Nothing outside this folder imports it.

The functions that run on executors are shipped by value, so that workers need
no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
