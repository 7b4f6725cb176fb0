"""Training-data operators: joins on n-grams, filters, extraction, scoring and mixing.

Functions of this package that run in Python workers are shipped by value: workers need numpy, pandas,
pyarrow and xxhash, but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
