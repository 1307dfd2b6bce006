"""Text-corpus preparation, batch model application and evaluation on Spark DataFrames.

Every operator is a lazy function from DataFrames (and column names) to a DataFrame,
or a column function from Columns to a Column.
"""

import sys

from pyspark import cloudpickle

# functions of this package travel to executors by value, so it need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
