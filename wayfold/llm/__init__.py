"""Operators of a training-data pipeline, their queries and the SQL that checks them."""

import sys

from pyspark import cloudpickle

# functions travel to the executors by value, so that these need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
