"""Quillmark: a preference-data engine on Spark DataFrames.

The package is registered for pickling by value, so that Python workers run its Arrow functions
even where only the driver can import it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
