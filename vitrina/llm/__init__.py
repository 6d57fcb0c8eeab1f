"""Operators for large training-data pipelines (text, URLs and embeddings).

Nothing outside this package imports it. Task functions defined here are
pickled by value, so executors need neither this repository nor its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
