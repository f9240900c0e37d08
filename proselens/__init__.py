"""proselens: text-complexity metrics and document classification on Spark.

Documents become per-document metric rows through DataFrame expressions;
metric rows become feature tables for ``pyspark.ml`` models.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions that run inside tasks travel by value: executors need not have this package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
