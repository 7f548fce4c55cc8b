"""Foliograph: file-corpus analytics written as Spark jobs."""

import sys

from pyspark import cloudpickle

# Arrow functions of this package travel with their code, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
