"""Document question answering as Spark jobs over tables and streams."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their own code, so a cluster needs no
# copy of this package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
