"""ragscope: retrieval-evaluation analytics as Spark DataFrame operators.

Every public operator takes DataFrames and returns a DataFrame; the work
runs as Spark jobs (joins, aggregates, windows, shuffles).  Python only
runs inside tasks where a built-in expression cannot state the semantics
(the fixed-size chunker and the dense top-k scorer).
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

from ragscope.session import checkpoint_dir, get_spark

# Functions of this package that run inside tasks (Arrow UDFs, mapInPandas
# bodies) are shipped by value, so executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__all__ = ["get_spark", "checkpoint_dir"]
