"""Registry analytics over Spark DataFrames.

Layers, lowest first:

* ``rules``      fixed values: vocabularies, dictionaries, pattern tables, thresholds
* ``functions``  Column -> Column building blocks
* ``sources``    landed files -> DataFrames
* ``operators``  DataFrame -> DataFrame steps
* ``sinks``      table maintenance and report tables
* ``streaming``  Structured Streaming forms
* ``plans``      ready-made queries over the driver tables
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# functions run in Python workers travel by value, so executors need no copy of
# this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
