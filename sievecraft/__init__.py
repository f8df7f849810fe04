"""Ranking, planning, gating and auditing of text records with Spark.

Python tasks are pickled by value, so executors need pandas and numpy, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
