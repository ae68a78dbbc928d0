"""rubricon: document-evaluation analytics on PySpark DataFrames.

Layers, from small to large:

* ``functions``  column expressions and the few Arrow functions Spark lacks
* ``operators``  DataFrame -> DataFrame steps (ranking, grading, retrieval, ...)
* ``sources``    readers and writers for answers, facts, rubrics, grades, bars
* ``plans``      composite jobs built from operators
* ``streaming``  incremental page ingestion
* ``catalog``    the registered queries with their equivalent SQL
"""

import sys

from pyspark import cloudpickle

# Arrow functions are shipped to executors by value, so a cluster needs no
# separate installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
