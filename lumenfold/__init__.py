"""lumenfold: a Spark-first engine for scene-collection data and embedding analysis.

Every operator takes and returns DataFrames (or Columns); nothing here starts a
session or collects unbounded data.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need no copy of this package: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
