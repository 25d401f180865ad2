"""Document ingestion and vector retrieval as Spark jobs.

``functions`` holds Column expressions, ``sources`` scans, ``operators`` DataFrame-to-DataFrame
steps, ``streaming`` the Structured Streaming twins, and ``plans`` the two end-to-end jobs
(load and ask) together with the catalogue of registered queries.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# What a task needs of this package travels with the task; executors need no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
