"""voxloom: speech-model training data prepared, batched and scored on Spark.

Every operator is a ``DataFrame -> DataFrame`` function or a ``Column``
builder.  The few Python callables that Spark ships to its workers are pickled
by value, so executors need numpy, pandas and pyarrow but not this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
