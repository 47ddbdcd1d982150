"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their code: workers need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
