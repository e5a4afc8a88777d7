"""Job-market matching and retrieval analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from hiregrain.session import build_session, materialize

# Functions sent to Python workers carry their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "materialize"]
