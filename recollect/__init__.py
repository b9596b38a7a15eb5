"""A PySpark-native engine for long-lived knowledge records."""

from pyspark import cloudpickle

import recollect as _here

# Functions of this package travel to the Python workers by value, so executors need
# numpy, pandas and pyarrow but not this package.
cloudpickle.register_pickle_by_value(_here)
