"""Analytics of ordered event sequences on Spark DataFrames."""

import sys as _sys

from pyspark.cloudpickle import register_pickle_by_value as _register

# what runs on the executors is sent with the job: they need no copy of this package
_register(_sys.modules[__name__])
