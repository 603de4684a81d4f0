"""Operations of a training-data pipeline; nothing else in the library imports this package.

Functions of this package that run in Python workers travel by value, so a
worker needs no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
