"""seqloom: sequence, matrix and table analytics expressed on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code, so that no machine of a cluster needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
