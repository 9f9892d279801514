"""Operators that prepare text for training language models.

Nothing else in the library imports this package. Every operator takes and returns
DataFrames; ``queries`` applies each of them to its benchmark table.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
