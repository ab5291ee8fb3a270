"""Operators for preparing language-model training data; nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# Functions travel to the Python workers with their code, so no package has to be installed or shipped there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
