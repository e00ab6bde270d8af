"""heatloom - urban heat risk analytics on Spark DataFrames.

Every operator is a function ``f(df, ...) -> DataFrame`` built from lazy
DataFrame expressions.  Statistics are kept per group key (``by``, normally the
area of interest), so one job serves any number of cities.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need
# not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
