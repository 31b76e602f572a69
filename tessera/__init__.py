"""Corpus analytics on Spark: annotated-text tables, joins, statistics and evaluation as DataFrame plans."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel whole, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
