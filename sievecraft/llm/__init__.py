"""Operators of a training-data pipeline over documents, pages and benchmark items.

Nothing outside this folder imports it. Its Python tasks are pickled by value,
so executors need numpy and the named libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
