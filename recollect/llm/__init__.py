"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.
"""

from pyspark import cloudpickle

import recollect.llm as _here

# Functions of this subpackage travel to the Python workers by value, so executors
# need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(_here)
